"""python -m kugiri: list, tokenize, build, train, export."""

import argparse
import json
import sys
from pathlib import Path

from kugiri.functions.formats import FORMATS, nbest_header
from kugiri.model import AnalysisError, Metadata
from kugiri.plans.analyzer import TokenizerBuilder, parse_filter_flag
from kugiri.sources.dictionary import Dictionary, UserDictionary, read_records, registry
from kugiri.sources.text import annotated_sentences
from kugiri.trainer.crf import CrfTrainer
from kugiri.trainer.lexicon import LexiconModel, LexiconTrainer, TrainingConfig


def tokenize(a: argparse.Namespace, out) -> None:
    builder = TokenizerBuilder().set_dictionary(a.dictionary).set_keep_whitespace(a.keep_whitespace)
    builder.set_mode(json.loads(a.mode) if a.mode.startswith("{") else a.mode)
    if a.user_dictionary:
        builder.set_user_dictionary(a.user_dictionary)
    if a.max_grouping_len:
        builder.set_max_grouping_len(a.max_grouping_len)
    for flag in a.char_filter:
        builder.append_character_filter(*parse_filter_flag(flag))
    for flag in a.token_filter:
        builder.append_token_filter(*parse_filter_flag(flag))
    tokenizer, show = builder.build(), FORMATS[a.output]
    with open(a.file, encoding="utf-8") if a.file else sys.stdin as lines:
        for line in lines:
            text = line.strip()
            if a.nbest < 2:
                out.write(show(tokenizer.tokenize(text)))
                continue
            for rank, (tokens, cost) in enumerate(tokenizer.tokenize_nbest(text, a.nbest, a.nbest_unique, a.nbest_cost_threshold), 1):
                out.write(nbest_header(rank, cost) + show(tokens))


def build(a: argparse.Namespace, out) -> None:
    metadata = Metadata.load(a.metadata)
    if a.user:
        UserDictionary.from_records(read_records(a.source, metadata.encoding), metadata).save(a.target)
        return
    made = Dictionary.build_from_folder(a.source, metadata)
    (made.remapped() if a.remap_ids else made).save(a.target)


def train(a: argparse.Namespace, out) -> None:
    config = TrainingConfig.read(a.seed, a.char_def, a.unk_def, a.feature_def, a.rewrite_def)
    crf = CrfTrainer(a.regularization, getattr(a, "lambda"), max_iter=a.max_iter)
    LexiconTrainer(config, crf).train(annotated_sentences(Path(a.corpus).read_text("utf-8"))).save(a.output)


def export(a: argparse.Namespace, out) -> None:
    base = Path(a.metadata).read_text("utf-8") if a.metadata else None
    out.write("\n".join(LexiconModel.load(a.model).export(a.output, base)) + "\n")


def show(a: argparse.Namespace, out) -> None:
    out.write("NAME\tEMBEDDED\tINSTALLED\tPATH\n")
    for name, embedded, installed, path in registry(a.folder):
        out.write(f"{name}\t{'yes' if embedded else 'no'}\t{'yes' if installed else 'no'}\t{path or '-'}\n")


def main(argv: list[str] | None = None, out=sys.stdout) -> int:
    p = argparse.ArgumentParser(prog="kugiri")
    s = p.add_subparsers(required=True)
    c = s.add_parser("list")
    c.add_argument("--folder")
    c.set_defaults(run=show)
    c = s.add_parser("tokenize")
    c.add_argument("file", nargs="?")
    c.add_argument("-d", "--dictionary", default="embedded://scripts")
    c.add_argument("-u", "--user-dictionary")
    c.add_argument("-m", "--mode", default="normal")
    c.add_argument("-o", "--output", choices=list(FORMATS), default="mecab")
    c.add_argument("--keep-whitespace", action="store_true")
    c.add_argument("--max-grouping-len", type=int)
    c.add_argument("--char-filter", action="append", default=[])
    c.add_argument("--token-filter", action="append", default=[])
    c.add_argument("-N", "--nbest", type=int, default=1)
    c.add_argument("--nbest-unique", action="store_true")
    c.add_argument("--nbest-cost-threshold", type=int)
    c.set_defaults(run=tokenize)
    c = s.add_parser("build")
    c.add_argument("--metadata", required=True)
    c.add_argument("--source", required=True)
    c.add_argument("--target", required=True)
    c.add_argument("--user", action="store_true")
    c.add_argument("--remap-ids", action="store_true")
    c.set_defaults(run=build)
    c = s.add_parser("train")
    for name in ("seed", "corpus", "char-def", "unk-def", "feature-def", "rewrite-def", "output"):
        c.add_argument(f"--{name}", required=True)
    c.add_argument("--lambda", type=float, default=0.01)
    c.add_argument("--max-iter", type=int, default=100)
    c.add_argument("--regularization", choices=["l1", "l2", "elastic_net"], default="l1")
    c.set_defaults(run=train)
    c = s.add_parser("export")
    c.add_argument("--model", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--metadata")
    c.set_defaults(run=export)
    a = p.parse_args(argv)
    try:
        a.run(a, out)
    except AnalysisError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
