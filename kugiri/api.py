"""The library's names in one place, and functions that build, load, train and export in one call."""

from pathlib import Path

from kugiri.model import AnalysisError, ErrorKind, Metadata, Mode, Penalty, Schema, Token
from kugiri.plans.analyzer import Segmenter, Tokenizer, TokenizerBuilder
from kugiri.sources.dictionary import Dictionary, UserDictionary, load_dictionary, read_records
from kugiri.sources.text import annotated_sentences
from kugiri.trainer.crf import CrfTrainer
from kugiri.trainer.lexicon import LexiconModel, LexiconTrainer, TrainingConfig


def build_dictionary(source: str, target: str, metadata: Metadata) -> Dictionary:
    """Builds the definition files of a folder into a dictionary folder."""
    made = Dictionary.build_from_folder(source, metadata)
    made.save(target)
    return made


def build_user_dictionary(source: str, target: str, metadata: Metadata) -> UserDictionary:
    made = UserDictionary.from_records(read_records(source, metadata.encoding), metadata)
    made.save(target)
    return made


def load_user_dictionary(uri: str, metadata: Metadata) -> UserDictionary:
    return UserDictionary.load(uri, metadata)


def train(seed: str, corpus: str, char_def: str, unk_def: str, feature_def: str, rewrite_def: str, output: str, cost: float = 0.01, max_iter: int = 100, regularization: str = "l1") -> LexiconModel:
    """Trains on a corpus file and writes the model."""
    config = TrainingConfig.read(seed, char_def, unk_def, feature_def, rewrite_def)
    model = LexiconTrainer(config, CrfTrainer(regularization, cost, max_iter=max_iter)).train(annotated_sentences(Path(corpus).read_text("utf-8")))
    model.save(output)
    return model


def export(model: str, output: str, metadata: str | None = None) -> list[str]:
    """Writes a model's dictionary files; gives their names."""
    return LexiconModel.load(model).export(output, Path(metadata).read_text("utf-8") if metadata else None)


__all__ = ["AnalysisError", "Dictionary", "ErrorKind", "LexiconModel", "Metadata", "Mode", "Penalty", "Schema", "Segmenter", "Token", "Tokenizer", "TokenizerBuilder", "UserDictionary", "build_dictionary", "build_user_dictionary", "export", "load_dictionary", "load_user_dictionary", "train"]
