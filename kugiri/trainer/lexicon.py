"""Training of a lexicon: templates, rewriting rules, lattices of annotated sentences, and the trained model's files."""

import json
import math
import re
from dataclasses import dataclass, field
from pathlib import Path

from kugiri.model import AnalysisError, ErrorKind
from kugiri.operators.lattice import is_kanji
from kugiri.sources.definitions import Categories
from kugiri.trainer.crf import CrfTrainer, FeatureSet, Lattice, Merged

VARIABLE = re.compile(r"%(?:([FLR])(\?)?\[(\d+)\]|([twulr]))")
#: Fixed value: the weight every user word has.
USER_WEIGHT = 0.8
SECTIONS = {"[unigram rewrite]": 0, "[left rewrite]": 1, "[right rewrite]": 2}
#: The order of character classes in training lattices.
CLASSES = ("DEFAULT", "HIRAGANA", "KATAKANA", "KANJI", "ALPHA", "NUMERIC")


class Template:
    """Text with variables: %F[n] %L[n] %R[n] fields, with ? required ones, %t character class, %w surface, %u %l %r all fields."""

    def __init__(self, text: str):
        self.text = text
        self.required = [int(m[3]) for m in VARIABLE.finditer(text) if m[2]]

    def fill(self, fields: list[str], whole: dict[str, str]) -> str | None:
        if any(i >= len(fields) or fields[i] in ("*", "") for i in self.required):
            return None
        return VARIABLE.sub(lambda m: whole.get(m[4], "") if m[4] else fields[int(m[3])] if int(m[3]) < len(fields) else "*", self.text)


class Extractor:
    """Feature ids of words by templates; ids count from 1 in the order in which features first appear."""

    def __init__(self, text: str):
        self.unigram: list[Template] = []
        self.bigram: list[tuple[Template, Template]] = []
        for line in text.splitlines():
            line = line.split("#", 1)[0].strip()
            parts = line.split(None, 1)
            if len(parts) != 2:
                continue
            if parts[0] == "UNIGRAM":
                self.unigram.append(Template(parts[1]))
            elif parts[0] == "BIGRAM":
                body = parts[1]
                left, slash, right = body.rpartition("/")
                if not slash:
                    raise AnalysisError(ErrorKind.CONTENT, f"bigram template without a slash: {body}")
                self.bigram.append((Template(left), Template(right)))
        self.ids: tuple[dict[str, int], ...] = ({}, {}, {})

    def _ids(self, kind: int, templates, fields, whole) -> list[int | None]:
        out, known = [], self.ids[kind]
        for t in templates:
            text = t.fill(fields, whole)
            out.append(None if text is None else known.setdefault(text, len(known) + 1))
        return out

    def feature_set(self, features: tuple[str, str, str], category: int, surface: str | None) -> FeatureSet:
        """features: those for unigrams, for the left place and for the right place."""
        whole = {"t": str(category), "w": surface or "", "u": features[0], "l": features[1], "r": features[2]}
        fields = [f.split(",") for f in features]
        unigram = [i for i in self._ids(0, self.unigram, fields[0], whole) if i]
        left = self._ids(1, [a for a, _ in self.bigram], fields[1], whole)
        right = self._ids(2, [b for _, b in self.bigram], fields[2], whole)
        return FeatureSet(unigram, right, left)


class Rewriter:
    """Rules for the three kinds of features; rules before any section head are for the right place.

    A pattern matches the first fields one by one: * any, (a|b) one of several, else the text. The rules are tried along their
    common beginnings, in the order in which they were given.
    """

    def __init__(self, text: str = ""):
        self.roots: tuple[list, ...] = ([], [], [])
        self.cache: dict[str, tuple[str, str, str]] = {}
        section = 2
        for line in text.splitlines():
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            if line in SECTIONS:
                section = SECTIONS[line]
                continue
            parts = re.split(r"[\t ]", line, maxsplit=1)
            if len(parts) == 2:
                self._add(self.roots[section], parts[0].split(","), parts[1].strip().split(","))

    @staticmethod
    def _add(node: list, patterns: list[str], rewrite: list[str]) -> None:
        for p in patterns:
            key = "*" if p == "*" else frozenset(p[1:-1].split("|")) if p[:1] == "(" and p[-1:] == ")" else (p,)
            child = next((c for k, c in node if k == key), None)
            if child is None:
                node.append((key, child := []))
            node = child
        node.append((None, rewrite))

    def _find(self, node: list, fields: list[str], at: int) -> list[str] | None:
        for key, child in node:
            if key is None:
                return child
            if at < len(fields) and (key == "*" or fields[at] in key) and (got := self._find(child, fields, at + 1)) is not None:
                return got
        return None

    def _one(self, root: list, feature: str) -> str:
        fields = feature.split(",")
        rule = self._find(root, fields, 0)
        if rule is None:
            return feature
        out = []
        for r in rule:
            m = re.fullmatch(r"\$([0-9]+)", r)
            out.append(r if not m else fields[int(m[1]) - 1] if 0 < int(m[1]) <= len(fields) else "")
        return ",".join(out)

    def rewrite(self, feature: str) -> tuple[str, str, str]:
        """The feature for unigrams, for the left place and for the right place."""
        if feature not in self.cache:
            self.cache[feature] = tuple(self._one(r, feature) for r in self.roots)
        return self.cache[feature]


def character_class(c: str) -> int:
    if c.isascii() and c.isdigit():
        return 5
    if c.isascii() and c.isalpha():
        return 4
    if is_kanji(c):
        return 3
    if "゠" <= c <= "ヿ":
        return 2
    return 1 if "぀" <= c <= "ゟ" else 0


@dataclass
class TrainingConfig:
    """Seed words (surface, feature), character classes, unknown features, templates, rules, and the texts they came from."""

    words: list[tuple[str, str]]
    categories: Categories
    unknown: dict[str, str]
    extractor: Extractor
    rewriter: Rewriter
    texts: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, seed: str, char_def: str, unk_def: str, feature_def: str, rewrite_def: str) -> "TrainingConfig":
        words = []
        for line in seed.splitlines():
            parts = line.split(",")
            if line.strip():
                if len(parts) < 5:
                    raise AnalysisError(ErrorKind.CONTENT, f"seed word with under five columns: {line}")
                words.append((parts[0], ",".join(parts[4:])))
        unknown = {}
        for line in unk_def.splitlines():
            parts = line.split(",")
            if line.strip() and not line.startswith("#") and len(parts) > 4:
                unknown[parts[0]] = ",".join(parts[4:])
        texts = {"char.def": char_def, "feature.def": feature_def, "rewrite.def": rewrite_def}
        return cls(words, Categories(char_def), unknown, Extractor(feature_def), Rewriter(rewrite_def), texts)

    @classmethod
    def read(cls, seed, char_def, unk_def, feature_def, rewrite_def) -> "TrainingConfig":
        try:
            return cls.parse(*(Path(p).read_text("utf-8") for p in (seed, char_def, unk_def, feature_def, rewrite_def)))
        except OSError as e:
            raise AnalysisError(ErrorKind.IO, str(e)) from e


class LexiconTrainer:
    def __init__(self, config: TrainingConfig, crf: CrfTrainer | None = None, max_grouping_len: int | None = None):
        self.config, self.crf, self.cap = config, crf or CrfTrainer("l1", 0.01), max_grouping_len
        self.default = ",".join(["*"] * (config.words[0][1].count(",") + 1)) if config.words else "*"
        self.sets: list[FeatureSet] = []
        self.labels: dict[tuple[str, str], int] = {}
        for surface, feature in config.words:
            category = config.categories.of(surface[0])[0] if surface else 0
            self.sets.append(config.extractor.feature_set(config.rewriter.rewrite(feature), category, surface))
            if surface:
                self.labels[feature, surface[0]] = len(self.sets)
        self.n_words = len(self.sets)
        for i, name in enumerate(config.categories.names):
            self.sets.append(config.extractor.feature_set(config.rewriter.rewrite(config.unknown.get(name, self.default)), i, None))

    def lattice(self, tokens: list[tuple[str, str]]) -> Lattice | None:
        """The correct path of a sentence first, then the unknown words at every place; None for a sentence without text.

        A correct word that is neither a seed word nor an unknown word of its class has no feature.
        """
        text = "".join(s for s, _ in tokens)
        if not text:
            return None
        out, at = Lattice(len(text)), 0
        for surface, feature in tokens:
            if not surface:
                continue
            label = self.labels.get((feature, surface[0]), 0)
            if not label:
                kind = character_class(surface[0])
                if feature.startswith(f"名詞,{CLASSES[kind]}") or feature == self.config.unknown.get(CLASSES[kind]):
                    label = self.n_words + kind + 1
            out.add(at, at + len(surface), label)
            at += len(surface)
        for i, c in enumerate(text):
            label = self.n_words + character_class(c) + 1
            for k in range(1, min(self.cap or 10, 3) + 1):
                if i + k <= len(text) and (i + k, label) != (out.nodes[i][0] if out.nodes[i] else None):
                    out.add(i, i + k, label)
        return out

    def train(self, corpus) -> "LexiconModel":
        """corpus: a list of sentences of (surface, feature), or a DataFrame with a column `tokens` of such structs."""
        if hasattr(corpus, "rdd"):
            made = self.lattice
            lattices = corpus.select("tokens").rdd.map(lambda r: made([(t["surface"], t["feature"]) for t in r["tokens"] or () if t["surface"]])).filter(lambda x: x is not None)
        else:
            lattices = [x for x in map(self.lattice, corpus) if x is not None]
        model = self.crf.train(lattices, self.sets)
        merged = model.merge()
        c = self.config
        return LexiconModel([s for s, _ in c.words], [f for _, f in c.words], list(c.categories.names), {n: c.unknown.get(n, self.default) for n in c.categories.names}, merged.words, merged.matrix, {i: [_feature(c.extractor.ids[2], f) for f in own] for i, own in enumerate(merged.left_features, 1)}, {i: [_feature(c.extractor.ids[1], f) for f in own] for i, own in enumerate(merged.right_features, 1)}, c.texts, merged.cost_factor())


def _feature(ids: dict[str, int], i: int | None) -> str:
    return next((k for k, v in ids.items() if v == i), "*") if i else "*"


def to_cost(weight: float, factor: int) -> int:
    """Minus the weight times the factor, halves away from zero, within 16 bits."""
    raw = -factor * weight
    return max(-32768, min(32767, int(math.copysign(math.floor(abs(raw) + 0.5), raw))))


@dataclass
class LexiconModel:
    surfaces: list[str]
    features: list[str]
    categories: list[str]
    unknown: dict[str, str]
    words: list[tuple[float, int, int]]
    matrix: list[dict[int, float]]
    left_ids: dict[int, list[str]]
    right_ids: dict[int, list[str]]
    texts: dict[str, str]
    cost_factor: int

    def weights(self) -> list[float]:
        return [w for w, _, _ in self.words[: len(self.surfaces)]]

    def evaluate(self) -> float:
        """The mean of the words' absolute weights; no accuracy."""
        own = self.weights()
        return sum(map(abs, own)) / len(own) if own else 0.0

    def lexicon(self) -> str:
        return "".join(f"{s},{left},{right},{to_cost(w, self.cost_factor)},{f}\n" for s, f, (w, left, right) in zip(self.surfaces, self.features, self.words))

    def unk_def(self) -> str:
        own = self.words[len(self.surfaces) :]
        return "".join(f"{n},{left},{right},{to_cost(w, self.cost_factor)},{self.unknown[n]}\n" for n, (w, left, right) in zip(self.categories, own))

    def matrix_def(self) -> str:
        """All pairs of ids; a pair without a weight has the greatest cost."""
        rights, lefts = len(self.matrix), 1 + max((x for _, x, _ in self.words), default=0)
        lines = [f"{rights} {lefts}"]
        for r, row in enumerate(self.matrix):
            lines += [f"{r} {x} {to_cost(row[x], self.cost_factor) if x in row else 32767}" for x in range(lefts)]
        return "\n".join(lines) + "\n"

    def id_def(self, side: dict[int, list[str]]) -> str:
        return "0 BOS/EOS\n" + "".join(f"{i} {','.join(f)}\n" for i, f in side.items())

    def infer_ids(self, surface: str, feature: str) -> tuple[int, int]:
        """Context ids of the trained word whose feature agrees best, where earlier fields weigh more; the first of equals.

        A feature that agrees with none takes the ids of the unknown word of the surface's character class.
        """
        fields, best, found = feature.split(","), 0, None
        for own, word in zip(self.features, self.words):
            other = own.split(",")
            n = min(len(fields), len(other))
            score = sum(n - i for i in range(n) if fields[i] == other[i])
            if score > best:
                best, found = score, word
        if found is None:
            kind = CLASSES[character_class(surface[0])] if surface else "DEFAULT"
            i = len(self.surfaces) + (self.categories.index(kind) if kind in self.categories else 0)
            found = self.words[i] if i < len(self.words) else (0.0, 0, 0)
        return found[1], found[2]

    def user_lexicon(self, words: list[tuple[str, str]]) -> str:
        """User words (surface, feature) with inferred ids and one cost for all."""
        cost = to_cost(USER_WEIGHT, self.cost_factor)
        return "".join("{},{},{},{},{}\n".format(s, *self.infer_ids(s, f), cost, f) for s, f in words)

    def bigram_details(self) -> tuple[str, str, str]:
        """The features of the left ids, of the right ids, and the cost of every trained pair of ids, one a line."""
        side = lambda ids: "".join(f"{i}\t" + ",".join("*" if x == "*" else f'"{x}"' for x in own) + "\n" for i, own in ids.items())
        name = lambda ids, i: ",".join(ids[i]) if i in ids else "BOS/EOS"
        pairs = "".join(f"{name(self.right_ids, r)}/{name(self.left_ids, x)}\t{to_cost(w, self.cost_factor)}\n" for r, row in enumerate(self.matrix) for x, w in sorted(row.items()))
        return side(self.left_ids), side(self.right_ids), pairs

    def metadata(self, base: str) -> str:
        """The base metadata with a default cost from the median weight, and what was trained."""
        try:
            out = json.loads(base)
        except ValueError as e:
            raise AnalysisError(ErrorKind.DESERIALIZE, str(e)) from e
        own = sorted(self.weights())
        if own:
            out["default_word_cost"] = int(abs(own[len(own) // 2] * 500.0)) + 1500
        most = max(max((x for _, x, _ in self.words), default=0), len(self.matrix) - 1)
        out["model_info"] = {"feature_count": len(own), "label_count": len(self.words), "connection_matrix_size": f"{most + 1}x{most + 1}"}
        return json.dumps(out, ensure_ascii=False, indent=2)

    def export(self, folder: str | Path, base_metadata: str | None = None) -> list[str]:
        """Writes the files from which a dictionary is built; gives their names."""
        folder = Path(folder)
        folder.mkdir(parents=True, exist_ok=True)
        files = {"lex.csv": self.lexicon(), "matrix.def": self.matrix_def(), "unk.def": self.unk_def(), **self.texts, "left-id.def": self.id_def(self.left_ids), "right-id.def": self.id_def(self.right_ids)}
        if base_metadata is not None:
            files["metadata.json"] = self.metadata(base_metadata)
        for name, text in files.items():
            (folder / name).write_text(text, "utf-8")
        return sorted(files)

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(self.__dict__, ensure_ascii=False), "utf-8")

    @classmethod
    def load(cls, path: str | Path) -> "LexiconModel":
        try:
            raw = json.loads(Path(path).read_text("utf-8"))
        except OSError as e:
            raise AnalysisError(ErrorKind.IO, str(e)) from e
        except ValueError as e:
            raise AnalysisError(ErrorKind.DESERIALIZE, str(e)) from e
        ints = lambda d: {int(k): v for k, v in d.items()}
        return cls(**{**raw, "words": [tuple(w) for w in raw["words"]], "matrix": [ints(r) for r in raw["matrix"]], "left_ids": ints(raw["left_ids"]), "right_ids": ints(raw["right_ids"])})


__all__ = ["LexiconModel", "LexiconTrainer", "Merged", "TrainingConfig", "Rewriter", "Extractor"]
