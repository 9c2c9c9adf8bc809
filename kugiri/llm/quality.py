"""Per-document text quality: a hidden Markov model labels each line prose, heading, list, table or junk.

The observations are line statistics (words, common words, digits, symbols, ends, markers, repetitions), computed for a
batch of texts at once. The model is fitted by Baum-Welch on the lines of all documents, from a starting point that weighs
as much as some thousand lines and from a few labelled texts (Fit). The labels' shares of the characters are summed per
document.
"""

import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kugiri.plans.shared import release, stable

LABELS = ("prose", "heading", "list", "table", "junk")
#: Characters handled at once; a longer text is one batch of its own.
BATCH_CHARS = 1_000_000
#: Observed lines handled at once; a longer text is one batch of its own.
BATCH_LINES = 200_000
BREAKS = re.compile(r"\r\n|[\r\x0b\x0c\x85  ]")
MARKER = re.compile(r"(?i)\s*(?:[-*•‣▪◦・–—]\s|\(?[0-9]{1,4}(?:\.[0-9]+)*[.):]?(?:\s|$)|\(?[a-z][.)]\s)")
SENTENCE_END = ".。．!?！？:;：；"

#: The fit sees every line of every document. Beyond so many documents all lines count less, equally, so that together they weigh
#: as much against the starting point as the lines of so many documents; else a larger table would wear the labels' meaning away.
#: The starting point counts as so many lines of each label, a line of the labelled texts as so many lines; and the fit takes so
#: many steps.
SAMPLE_DOCUMENTS, PRIOR_LINES, LABELLED_LINES, STEPS = 1_000, 20_000, 100, 6

#: Chance of each observation in a line of each label (prose, heading, list, table, junk), where the fit starts.
EMISSION = {
    "common": (0.85, 0.40, 0.15, 0.01, 0.03),  # common words make up a tenth of the words
    "no common among many": (0.08, 0.02, 0.20, 0.30, 0.45),  # five words or more, under 14, and none is common
    "no common among very many": (0.0003, 0.0003, 0.30, 0.05, 0.35),  # 14 words or more and none is common
    "long": (0.75, 0.10, 0.25, 0.25, 0.45),  # seven words, or letters of an unspaced script to match
    "sentence end": (0.60, 0.02, 0.25, 0.05, 0.08),
    "ideographic stop": (0.20, 0.001, 0.001, 0.001, 0.002),
    "marker": (0.25, 0.08, 0.75, 0.10, 0.15),
    "digits": (0.01, 0.02, 0.12, 0.75, 0.20),  # three tenths of the visible characters
    "numbers": (0.03, 0.01, 0.10, 0.70, 0.20),  # three numbers or more, at least half of all words
    "symbols": (0.02, 0.04, 0.15, 0.30, 0.40),  # a quarter of the visible characters
    "fields": (0.01, 0.01, 0.12, 0.60, 0.25),  # two bars, tabs, wide gaps or arrows
    "leader": (0.005, 0.005, 0.30, 0.05, 0.03),  # a run of dots
    "enumeration": (0.01, 0.005, 0.30, 0.20, 0.10),  # a separator for every second word
    "repeated": (0.002, 0.005, 0.01, 0.02, 0.30),  # three words in ten equal the one before
    "few letters": (0.001, 0.01, 0.01, 0.02, 0.30),  # 20 letters or more, of at most 7 kinds
    "small start": (0.30, 0.02, 0.10, 0.03, 0.20),  # begins with a small letter
    "code": (0.02, 0.02, 0.03, 0.08, 0.45),  # characters, calls and dotted names of programs
    "joined fields": (0.01, 0.01, 0.03, 0.50, 0.05),  # two separators or more without a blank behind
    "few words": (0.08, 0.45, 0.45, 0.20, 0.20),  # one or two, in a spaced script
    "long token": (0.01, 0.01, 0.02, 0.05, 0.35),  # 25 characters without a blank, in a spaced script
}
#: Chance of the next line's label, row by row.
TRANSITION = (
    (0.84, 0.10, 0.02, 0.02, 0.02),
    (0.60, 0.10, 0.10, 0.10, 0.10),
    (0.04, 0.03, 0.90, 0.02, 0.01),
    (0.04, 0.03, 0.02, 0.90, 0.01),
    (0.04, 0.03, 0.01, 0.02, 0.90),
)
START = (0.35, 0.50, 0.05, 0.05, 0.05)

#: Made-up texts of one label each, which hold the labels to their meaning.
LABELLED = {
    "prose": [
        "The valve is opened by the lever, and the water flows into\nthe lower chamber of the housing until it is full.\nThen the spring closes the valve again, so that no water is lost.",
        "Das Gehäuse wird mit dem Deckel verschlossen, der an einer\nWelle gelagert ist. Die Feder drückt den Hebel in die Ruhelage.",
        "She walked along the river at dusk,\nand the lamps were lit on the bridge,\nwhile the last boats came home with the tide\nand nobody spoke of the storm.",
    ],
    "list": [
        "apple\npear\nquince\nmedlar\nplum\ncherry\nsloe\nbullace\ngreengage\ndamson",
        "- bolts and washers\n- hex nuts\n- a torque wrench\n- thread sealant\n- spare gaskets",
        "1) drain tank\n2) remove cover\n3) replace seal\n4) refit cover\n5) fill tank",
    ],
    "table": [
        "id,name,city,amount\n17,Weber,Ulm,203.50\n18,Kahn,Graz,77.10\n19,Ruiz,Lugo,1204.00\n20,Petit,Metz,9.95",
        "part | size | mass\nA-11 | 40 | 1.25\nB-07 | 35 | 0.80\nC-90 | 12 | 0.15",
        "Speed 10 20 30\nForce 1.2 2.5 3.9\nTorque 4 8 13\nNoise 51 55 60",
    ],
    "junk": [
        "import os\nfrom sys import argv\n\ndef main(path):\n    for name in os.listdir(path):\n        if name.endswith('.txt'):\n            print(os.path.join(path, name))\n\nif __name__ == '__main__':\n    main(argv[1])",
        "int main(void) {\n  int i = 0;\n  while (i < 10) { printf(\"%d\", i++); }\n  return 0;\n}",
        "var list = [];\nitems.forEach(function(x) { list.push(x.id); });\n$('#menu').html(list.join('&nbsp;'));",
        "aGVsbG8gd29ybGQsIHRoaXMgaXMgbm90IHRleHQ9PQ1a2b3c4d5e6f\nZm9vYmFyYmF6cXV4MTIzNDU2Nzg5MGFiY2RlZmdoaWprbG1ub3A=",
        "%%% @@@ ### *** &&& ^^^ ~~~\n@@## $$%% ^^&& **(( ))__",
    ],
}

#: Characters of programs, those that end their lines, and separators of fields.
CODE = np.array([ord(c) for c in "{}=<>_\\#$&^~`"], np.uint32)
CODE_END = np.array([ord(c) for c in ":;{}"], np.uint32)
TIGHT = np.array([ord(c) for c in ",;|\t"], np.uint32)
OTHER, SPACE, BREAK, LETTER, DIGIT, HIRAGANA, UNSPACED = range(7)
#: A line's observations as one number.
BITS = 1 << np.arange(len(EMISSION))
#: Chances are summed in whole parts of this size, so that no sum depends on the order, the batches or the partitions.
UNIT = 1 << 30
MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """The class of every code point, made once in a process."""
    if not _TABLE:
        table = np.zeros(sys.maxunicode + 1, np.uint8)
        kinds = {"L": LETTER, "M": LETTER, "N": DIGIT, "Z": SPACE, "C": SPACE}
        for i in range(sys.maxunicode + 1):
            table[i] = kinds.get(unicodedata.category(chr(i))[0], OTHER)
        for low, high in ((0x3041, 0x3097),):
            table[low:high] = HIRAGANA
        for low, high in ((0x30A1, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000), (0x0E00, 0x0E80)):
            table[low:high] = UNSPACED
        table[0x25CB] = OTHER
        table[10] = BREAK
        powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(63, MIX)))
        _TABLE.extend([table, powers])
    return _TABLE[0]


def _word_hash(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Summands whose total over a word is its hash."""
    return (codes.astype(np.uint64) + np.uint64(1)) * (np.uint64(0xD6E8FEB86659FD93) ^ (codes.astype(np.uint64) << np.uint64(17))) * _TABLE[1][at & 63]


class Parameters:
    """Chances of observations by label, of the next label and of the first."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray, start: np.ndarray):
        self.emission, self.transition, self.start = emission, transition, start

    @classmethod
    def given(cls) -> "Parameters":
        """The starting point."""
        return cls(np.array(list(EMISSION.values())).T, np.array(TRANSITION), np.array(START))

    def scores(self, seen: np.ndarray) -> np.ndarray:
        """Log-likelihood of every line's observations under each label; bit for bit the same beside any other lines."""
        out = np.repeat(np.log(1 - self.emission).sum(1)[None], len(seen), 0)
        for one, weight in zip(seen.T, np.log(self.emission / (1 - self.emission)).T):
            out += one[:, None] * weight
        return out


class Fit:
    """Baum-Welch over chains of lines, with the starting point and the labelled texts as lines seen before."""

    def __init__(self, labelled: list[tuple[int, np.ndarray]], start: Parameters):
        f = start.emission.shape[1]
        self.lines = np.full(len(LABELS), float(PRIOR_LINES))
        self.ones = start.emission * PRIOR_LINES
        self.moves, self.first = start.transition * PRIOR_LINES, start.start * PRIOR_LINES
        for label, seen in labelled:
            self.lines[label] += LABELLED_LINES * len(seen)
            self.ones[label] += LABELLED_LINES * seen.sum(0)
            self.moves[label, label] += LABELLED_LINES * max(0, len(seen) - 1)
        self.parameters = self._made(np.zeros((len(LABELS), f)), np.zeros(len(LABELS)), np.zeros((len(LABELS),) * 2), np.zeros(len(LABELS)))

    def _made(self, ones, lines, moves, first) -> Parameters:
        emission = np.clip((self.ones + ones) / (self.lines + lines)[:, None], 1e-4, 1 - 1e-4)
        moves, first = self.moves + moves, self.first + first
        return Parameters(emission, moves / moves.sum(1, keepdims=True), first / first.sum())

    @staticmethod
    def expected(p: Parameters, seen: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chances of every line's label, summed chances of neighbouring labels and of first labels, in whole UNITs."""
        labels, moves, first = Fit._chances(p, p.scores(seen), lengths)
        return labels.T / UNIT, moves / UNIT, first / UNIT

    @staticmethod
    def _chances(p: Parameters, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As expected(), times UNIT and with a row for each label; all chains a line at a time."""
        size = -np.sort(-lengths)
        alive = np.searchsorted(-size, -np.arange(1, size[0] + 1 if len(size) else 1), side="right")
        begin = np.cumsum(alive) - alive
        rank = np.empty(len(lengths), np.int64)
        rank[np.argsort(-lengths, kind="stable")] = np.arange(len(lengths))
        # the first lines of all chains come first, then the second ones
        at = begin[np.arange(len(scores)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] + np.repeat(rank, lengths)
        like = np.empty((len(LABELS), len(scores)))
        like[:, at] = np.exp(scores - scores.max(1, keepdims=True)).T
        ahead, behind, scale = np.empty_like(like), np.ones_like(like), np.empty(len(scores))
        moves = np.zeros((len(LABELS),) * 2)
        for t, k in enumerate(alive):
            here = slice(begin[t], begin[t] + k)
            now = like[:, here] * ((ahead[:, None, begin[t - 1] : begin[t - 1] + k] * p.transition[:, :, None]).sum(0) if t else p.start[:, None])
            scale[here] = now.sum(0)
            ahead[:, here] = now / scale[here]
        for t in range(len(alive) - 1, 0, -1):
            here, before = slice(begin[t], begin[t] + alive[t]), slice(begin[t - 1], begin[t - 1] + alive[t])
            ways = p.transition[:, :, None] * (like[:, here] * behind[:, here] / scale[here])
            behind[:, before] = ways.sum(1)
            moves += np.rint(ways * ahead[:, None, before] * UNIT).sum(2)
        labels = np.rint(ahead * behind * UNIT)
        return labels[:, at], moves, labels[:, : alive[0] if len(alive) else 0].sum(1)

    @classmethod
    def counts(cls, p: Parameters, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """What step() takes, in UNITs and one row, from consecutive chains of lines whose observations are BITS."""
        kinds, which = np.unique(codes, return_inverse=True)
        seen = _seen(kinds)
        labels, moves, first = cls._chances(p, p.scores(seen)[which], lengths)
        by_kind = np.array([np.bincount(which, row, minlength=len(kinds)) for row in labels])
        return np.concatenate([x.ravel() for x in (by_kind @ seen, by_kind.sum(1), moves, first)]).astype(np.int64)

    def step(self, counts: np.ndarray) -> Parameters:
        """The parameters after a step over chains of these counts, in lines."""
        k, f = self.ones.shape
        ones, lines, moves, first = np.split(counts, np.cumsum([k * f, k, k * k]))
        self.parameters = self._made(ones.reshape(k, f), lines, moves.reshape(k, k), first)
        return self.parameters


def _seen(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] & BITS > 0).astype(np.float64)


def _viterbi(start: np.ndarray, transition: np.ndarray, emission: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The most likely labels (Viterbi) of consecutive chains of lines, all chains a line at a time."""
    out = np.zeros(len(emission), np.int8)
    begin = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    begin, size = begin[order], lengths[order]
    if not len(size) or not size[0]:
        return out
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    back = np.zeros((len(emission), len(LABELS)), np.int8)
    score = start + emission[begin[: alive[0]]]
    final = np.zeros(len(size), np.int8)
    for t in range(1, size[0]):
        k = alive[t]
        final[k : len(score)] = score[k:].argmax(1)
        ways = score[:k, :, None] + transition
        best = ways.argmax(1)
        back[begin[:k] + t] = best
        score = np.take_along_axis(ways, best[:, None, :], 1)[:, 0] + emission[begin[:k] + t]
    final[: len(score)] = score.argmax(1)
    state = final
    for t in range(size[0] - 1, -1, -1):
        k = alive[t]
        out[begin[:k] + t] = state[:k]
        state[:k] = back[begin[:k] + t, state[:k]]
    return out


class Model:
    """words: the common words of all languages together."""

    def __init__(self, words: list[str], parameters: Parameters | None = None):
        self.table = _classes()
        low = sorted({w.lower() for w in words if w})
        spaced, self.single, self.pairs = [], set(), set()
        for w in low:
            codes = np.array([ord(c) for c in w], np.uint32)
            if self.table[codes[0]] in (HIRAGANA, UNSPACED):
                (self.single.add(ord(w)) if len(w) == 1 else self.pairs.add(ord(w[0]) << 21 | ord(w[1])))
            else:
                spaced.append(_word_hash(codes, np.arange(len(codes))).sum(dtype=np.uint64))
        self.common = np.unique(np.array(spaced or [0], np.uint64))
        self.single = np.array(sorted(self.single) or [0], np.uint32)
        self.pairs = np.array(sorted(self.pairs) or [0], np.int64)
        self.parameters = parameters or Fit(self.labelled(), Parameters.given()).parameters
        self.transition, self.start = np.log(self.parameters.transition), np.log(self.parameters.start)

    def labelled(self) -> list[tuple[int, np.ndarray]]:
        """Label and observed lines of each labelled text."""
        return [(LABELS.index(name), lines) for name, texts in LABELLED.items() for lines in self.chains(texts)]

    def lines(self, text: str) -> dict[str, np.ndarray]:
        """Statistics of every line of a lower-case text that ends with a line break."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = self.table[codes]
        idx = np.arange(len(codes))
        ends = np.flatnonzero(cls == BREAK)
        n = len(ends)
        starts = np.concatenate(([0], ends[:-1] + 1))
        line = np.zeros(len(codes), np.int32)
        line[ends[:-1] + 1] = 1
        line = np.cumsum(line, dtype=np.int32)
        count = np.bincount(line * 8 + cls, minlength=n * 8).reshape(n, 8)
        visible = count[:, [OTHER, LETTER, DIGIT, HIRAGANA, UNSPACED]].sum(1)
        out = {"chars": ends - starts, "visible": visible, "symbols": count[:, OTHER], "digits": count[:, DIGIT], "letters": count[:, LETTER] + count[:, HIRAGANA] + count[:, UNSPACED], "unspaced": count[:, HIRAGANA] + count[:, UNSPACED]}

        def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
            return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

        letter = cls == LETTER
        first, last = runs(letter)
        at = idx[letter] - np.repeat(first, last - first)
        h = np.add.reduceat(_word_hash(codes[letter], at), np.cumsum(last - first) - (last - first)) if len(first) else np.empty(0, np.uint64)
        own = line[first]
        per = lambda where, w=None: np.bincount(where, w, minlength=n)
        out["words"], out["word chars"] = per(own), per(own, last - first)
        out["common"] = per(own[np.isin(h, self.common)])
        out["again"] = per(own[1:][(h[1:] == h[:-1]) & (own[1:] == own[:-1])]) if len(h) > 1 else np.zeros(n)
        numbers, _ = runs(cls == DIGIT)
        out["numbers"] = per(line[numbers])
        kana = np.flatnonzero(cls == HIRAGANA)
        one = kana[np.isin(codes[kana], self.single)]
        following = np.minimum(kana + 1, len(codes) - 1)
        two = kana[np.isin(codes[kana].astype(np.int64) << 21 | codes[following], self.pairs)]
        out["common chars"] = per(line[one]) + 2 * per(line[two])
        seen = (cls != SPACE) & (cls != BREAK)
        first, last = runs(seen)
        longest = np.zeros(n, np.int64)
        if len(first):
            own = line[first]
            head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            longest[own[head]] = np.maximum.reduceat(last - first, head)
        out["longest"] = longest
        final = np.maximum.reduceat(np.where(seen, idx, -1), starts)
        final = np.where(final >= starts, final, -1)
        out["final"] = np.where(final >= 0, codes[np.maximum(final, 0)], 0)
        blank = codes == 32
        gap = np.flatnonzero(blank[1:] & blank[:-1]) + 1
        gap = gap[~blank[gap - 2] | (gap < 2)] if len(gap) else gap
        out["fields"] = per(line[np.isin(codes, np.array([9, 0x7C, 0xBB, 0xFF5C], np.uint32))]) + per(line[gap])
        out["separators"] = per(line[np.isin(codes, np.array([0x2C, 0x3B, 0x3001, 0x7C], np.uint32))])
        dots = codes == 0x2E
        kinds = np.bitwise_or.reduceat(np.where(letter, np.uint64(1) << (codes.astype(np.uint64) & np.uint64(63)), np.uint64(0)), starts)
        out["kinds"] = np.bitwise_count(kinds)
        out["leader"] = per(line[np.flatnonzero(dots[3:] & dots[2:-1] & dots[1:-2] & dots[:-3])]) if len(codes) > 3 else np.zeros(n)
        out["stops"] = per(line[codes == 0x3002])
        out["program"] = per(line[np.isin(codes, CODE)])
        # a bracket or a dot between letters, without blanks
        joined = letter[:-1] & (codes[1:] == 0x28)
        dotted = letter[:-2] & (codes[1:-1] == 0x2E) & letter[2:]
        out["calls"] = per(line[np.flatnonzero(joined)]) + per(line[np.flatnonzero(dotted)])
        tight = np.isin(codes[:-1], TIGHT) & (cls[1:] != SPACE) & (cls[1:] != BREAK)
        out["tight"] = per(line[np.flatnonzero(tight)])
        return out

    def observe(self, s: dict[str, np.ndarray], marker: np.ndarray, small: np.ndarray) -> np.ndarray:
        words = s["words"] + s["unspaced"] / 2.5
        visible = np.maximum(s["visible"], 1)
        common = s["common"] + s["common chars"] / 1.5
        by_letters = s["unspaced"] * 2 > s["letters"]
        # two words in ten may be rarer where words are not told apart
        share = common / np.maximum(words, 1)
        return np.stack([
            share >= 0.1,
            (words >= 5) & (words < 14) & (common == 0),
            (words >= 14) & (common == 0),
            words >= 7,
            np.isin(s["final"], np.array([ord(c) for c in SENTENCE_END])),
            s["stops"] > 0,
            marker,
            s["digits"] >= 0.3 * visible,
            (s["numbers"] >= 3) & (s["numbers"] * 2 >= s["numbers"] + s["words"]),
            s["symbols"] >= 0.25 * visible,
            s["fields"] >= 2,
            s["leader"] > 0,
            (s["separators"] >= 3) & (s["separators"] * 2.2 >= words + s["numbers"]),
            s["again"] >= 0.3 * np.maximum(words, 3),
            (s["letters"] >= 20) & (s["kinds"] <= 7) & ~by_letters,
            small,
            (s["program"] >= 2) | (s["calls"] >= 2) | (s["program"] + s["calls"] >= 1) & np.isin(s["final"], CODE_END),
            (s["tight"] >= 2) & ~by_letters,
            (s["words"] + s["numbers"] <= 2) & ~by_letters,
            (s["longest"] >= 25) & ~by_letters,
        ], 1).astype(np.float64)

    def label(self, emission: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The most likely labels of consecutive chains of lines."""
        return _viterbi(self.start, self.transition, emission, lengths)

    def chains(self, texts: list[str]) -> list[np.ndarray]:
        """The observed lines of each text, blank ones left out."""
        *_, full, own, seen = self._observed(texts)
        return np.split(seen, np.cumsum(np.bincount(own[full], minlength=len(texts)))[:-1])

    def _observed(self, texts: list[str]):
        parts = [BREAKS.sub("\n", t) for t in texts]
        text = "\n".join(parts) + "\n"
        lines, text = text.split("\n")[:-1], text.lower()
        per_text = np.array([p.count("\n") + 1 for p in parts])
        s = self.lines(text)
        own = np.repeat(np.arange(len(texts)), per_text)
        full = s["visible"] > 0
        where = np.flatnonzero(full)
        marker = np.fromiter((MARKER.match(lines[i]) is not None for i in where), bool, len(where))
        small = np.fromiter((lines[i].lstrip()[:1].islower() for i in where), bool, len(where))
        return s, full, own, self.observe({k: v[full] for k, v in s.items()}, marker, small)

    def statistics(self, texts: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Statistics of each text that need no labels; of all lines but blank ones the observations as BITS and the characters;
        and the number of these lines by text."""
        s, full, own, seen = self._observed(texts)
        total = {k: np.bincount(own, v, minlength=len(texts)) for k, v in s.items() if k in ("words", "word chars", "symbols", "visible", "common", "unspaced", "common chars", "digits")}
        units = total["words"] + total["unspaced"]
        n_lines = np.bincount(own[full], minlength=len(texts))
        out = {
            "n_chars": np.array([len(t) for t in texts], np.int64),
            "n_lines": n_lines,
            "n_words": total["words"].astype(np.int64),
            "mean_word_length": total["word chars"] / np.maximum(total["words"], 1),
            "symbol_ratio": total["symbols"] / np.maximum(total["visible"], 1),
            "digit_ratio": total["digits"] / np.maximum(total["visible"], 1),
            "line_end_share": np.bincount(own[full], seen[:, list(EMISSION).index("sentence end")], minlength=len(texts)) / np.maximum(n_lines, 1),
            "common_share": (total["common"] + total["common chars"]) / np.maximum(units, 1),
        }
        return out, (seen @ BITS).astype(np.int32), s["chars"][full], n_lines

    def measure(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Statistics of each text."""
        out, codes, chars, lengths = self.statistics(texts)
        return out | label_chars(self.parameters, codes, chars, lengths)


def label_chars(p: Parameters, codes: np.ndarray, chars: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    """Characters of each chain of lines by label."""
    kinds, which = np.unique(codes, return_inverse=True)
    labels = _viterbi(np.log(p.start), np.log(p.transition), p.scores(_seen(kinds))[which], lengths)
    sums = np.bincount(np.repeat(np.arange(len(lengths)), lengths) * 8 + labels, chars, minlength=len(lengths) * 8).reshape(len(lengths), 8)
    return {f"{l}_chars": sums[:, i].astype(np.int64) for i, l in enumerate(LABELS)}


PLAIN = {"n_chars": "long", "n_lines": "long", "n_words": "long", "mean_word_length": "double", "symbol_ratio": "double", "digit_ratio": "double", "line_end_share": "double", "common_share": "double"}
STATISTICS = PLAIN | {f"{l}_chars": "long" for l in LABELS}
#: What the labels of a text's lines come from.
LINES = {"line_codes": "array<int>", "line_chars": "array<int>"}


def _pieces(lengths: np.ndarray, most: int):
    """(first, end) of rows whose lengths come to at most so much, or of one longer row."""
    lengths = np.cumsum(lengths.astype(np.int64) + 1)
    at = 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def _texts(texts: pa.Array):
    """(first, end, texts) of BATCH_CHARS characters together; NULL is empty."""
    for at, to in _pieces(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False), BATCH_CHARS):
        yield at, to, [t or "" for t in texts.slice(at, to - at).to_pylist()]


def _chains(lines: pa.Array):
    """(first, end, lengths) of BATCH_LINES lines together."""
    lengths = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    for at, to in _pieces(lengths, BATCH_LINES):
        yield at, to, lengths[at:to]


def _columns(got: dict[str, np.ndarray], kinds: dict[str, str]) -> list[pa.Array]:
    return [pa.array(got[k], pa.int64() if kind == "long" else pa.float64()) for k, kind in kinds.items()]


def _schema(id: str, documents: DataFrame, kinds: dict[str, str], name: str | None = None) -> str:
    return f"`{name or id}` {documents.schema[id].dataType.simpleString()}, " + ", ".join(f"{k} {v}" for k, v in kinds.items())


def observe(documents: DataFrame, common_words: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the id as `id`, PLAIN, and LINES of its lines that aren't blank."""
    state: dict = {}

    def rows(batches):
        if not state:
            state["model"] = Model(common_words)
        for b in batches:
            for at, to, texts in _texts(b.column(1)):
                got, codes, chars, lengths = state["model"].statistics(texts)
                ends = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
                lines = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (codes, chars)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), *_columns(got, PLAIN), *lines], ["id", *PLAIN, *LINES])

    return documents.select(id, text).mapInArrow(rows, _schema(id, documents, PLAIN | LINES, "id"))


def fit(documents: DataFrame, common_words: list[str], id: str = "doc_id", text: str = "text") -> Parameters:
    """Parameters fitted on all documents."""
    observed = stable(observe(documents, common_words, id, text).select("line_codes"))
    try:
        return fit_observed(observed, common_words)
    finally:
        release(observed)


def fit_observed(observed: DataFrame, common_words: list[str]) -> Parameters:
    """Parameters fitted on all rows of observe(). In each step every task sums the counts of its lines; only the sums come to
    the driver."""
    model = Fit(Model(common_words).labelled(), Parameters.given())
    for _ in range(STEPS):
        parameters = model.parameters

        def summed(batches):
            rows, counts = 0, 0
            for b in batches:
                rows += b.num_rows
                for at, to, lengths in _chains(b.column(0)):
                    counts += Fit.counts(parameters, b.column(0).slice(at, to - at).flatten().to_numpy(), lengths)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([[rows, *counts.tolist()]], pa.list_(pa.int64()))], ["sums"])

        sums = [sum(s) for s in zip(*(r.sums for r in observed.select("line_codes").mapInArrow(summed, "sums array<long>").collect()))]
        if not sums:
            break
        model.step(np.array([n / UNIT for n in sums[1:]]) * min(1.0, SAMPLE_DOCUMENTS / sums[0]))
    return model.parameters


def measure(documents: DataFrame, common_words: list[str], id: str = "doc_id", text: str = "text", parameters: Parameters | None = None) -> DataFrame:
    """One row of statistics per document: the id and STATISTICS.

    *_chars are the characters in lines of each label, without line breaks and blank lines. A NULL text counts as an empty
    one: every statistic is 0. common_words are those of all languages, as a document's language may be missing or wrong.
    parameters: of the line model, see fit(); by default the starting point with the labelled texts.
    """
    state: dict = {}

    def rows(batches):
        if not state:
            state["model"] = Model(common_words, parameters)
        for b in batches:
            for at, to, texts in _texts(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), *_columns(state["model"].measure(texts), STATISTICS)], [id, *STATISTICS])

    return documents.select(id, text).mapInArrow(rows, _schema(id, documents, STATISTICS))


def measure_fitted(documents: DataFrame, common_words: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """measure() with the parameters of fit(). The texts are read once: their observed lines are written to the shared folder,
    then fitted and labelled from there."""
    observed = stable(observe(documents, common_words, id, text))
    parameters = fit_observed(observed, common_words)

    def rows(batches):
        for b in batches:
            codes, chars = b.column(len(PLAIN) + 1), b.column(len(PLAIN) + 2)
            for at, to, lengths in _chains(codes):
                got = label_chars(parameters, *(x.slice(at, to - at).flatten().to_numpy() for x in (codes, chars)), lengths)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(at, to - at) for i in range(len(PLAIN) + 1)), *(pa.array(x) for x in got.values())], [id, *STATISTICS])

    return observed.mapInArrow(rows, _schema(id, documents, STATISTICS))


def not_prose(statistics: DataFrame) -> DataFrame:
    """The documents with more characters in lists, tables and junk than in sentences. One without lines is none."""
    return statistics.where(F.col("list_chars") + F.col("table_chars") + F.col("junk_chars") > F.col("prose_chars"))
