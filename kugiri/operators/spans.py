"""Texts cut into spans that every path breaks between, so that each distinct span is searched once and its occurrences are counted."""

import re
from collections import defaultdict

from kugiri.operators.lattice import MOST_BYTES, MOST_COST, Lattice, sentences

#: Characters behind which a sentence is cut.
ENDS = "\n\t。、"


def _class(ranges) -> str:
    return "".join(f"{re.escape(chr(low))}-{re.escape(chr(high))}" for low, high in ranges)


def unbounded(lattice: Lattice) -> bool:
    """Whether no sentence's path can reach MOST_COST, so that path costs are plain sums."""
    d = lattice.d
    words = [d.words.cost.tolist(), [e[3] for e in d.user_dictionary.rows] if d.user_dictionary else [], [e[2] for own in d.unknown for e in own]]
    dearest = max((max(own) for own in words if own), default=0) + int(d.matrix.max(initial=0))
    return dearest * (MOST_BYTES + 1) < MOST_COST


def separable(lattice: Lattice) -> bool:
    """Whether what stands on both sides of a place that no word crosses is independent.

    So it is when all connections cost the same, characters have one category each, a word's cost doesn't depend on what follows
    (normal mode), and costs are plain sums.
    """
    d = lattice.d
    if lattice.mode.penalty is not None or any(len(own) > 1 for own in d.categories.by_edge) or not d.matrix.size or d.matrix.min() != d.matrix.max():
        return False
    return unbounded(lattice)


class Spans:
    """Cuts for lattices of equal categories, all of them separable.

    Unknown words end with the run of their category, so texts are cut behind runs (blanks go with what follows) and where
    sentences end, except where a lexicon or user word stands across the cut. A coarser cut is as right as a finer one.
    """

    def __init__(self, lattices: list[Lattice]):
        cats = lattices[0].d.categories
        ranges = defaultdict(list)
        for low, high, (name,) in cats.rows():
            ranges[name].append((low, high))
        ends = f"[{ENDS}]"
        runs, blank = [], ""
        # most characters have a range of their own; DEFAULT has the rest
        for name, own in sorted(ranges.items(), key=lambda x: x[0] == "DEFAULT"):
            some = f"[{_class(own)}]"
            if any(re.match(some, c) for c in ENDS):
                inner = f"(?:(?!{ends}){some})"
                run = f"{inner}*(?={ends}){some}|{inner}+"
            else:
                inner, run = some, f"{some}+"
            if cats.space is not None and name == cats.names[cats.space]:
                blank = inner
            runs.append(run)
        cut = f"(?:{'|'.join(runs)})"
        self.pattern = re.compile(f"{blank}*{cut}|{blank}+" if blank else cut)
        single = re.compile(cut)
        #: By what a word holds before one of its cuts: what it holds behind it.
        self.heads: dict[str, set[str]] = defaultdict(set)
        for trie in (t for x in lattices for t in (x.d.system, x.d.user) if t is not None):
            for surface in trie.own:
                at = [m.end() for m in single.finditer(surface)][:-1]
                # a word across the end of a sentence never occurs
                if at and not any(surface[a - 1] in ENDS for a in at):
                    for a in at:
                        self.heads[surface[:a]].add(surface[a:])
        self.lengths = sorted({*map(len, self.heads)})

    def tails_of(self, span: str) -> tuple[str, ...]:
        """What would have to follow the span for a word to stand across its end."""
        return tuple({t for n in self.lengths if n <= len(span) for t in self.heads.get(span[-n:], ())})

    def _joined(self, spans: list[str], tails) -> list[str]:
        """Spans of a sentence or more, those that share a word put together."""
        out: list[str] = []
        until, at = 0, 0
        for i, span in enumerate(spans):
            if at < until:
                out[-1] += span
            else:
                out.append(span)
            at += len(span)
            if own := tails(span):
                longest = max(map(len, own))
                following, k = "", i + 1
                while k < len(spans) and len(following) < longest:
                    following += spans[k]
                    k += 1
                until = max([until, *(at + len(t) for t in own if following.startswith(t))])
        return out

    def of(self, text: str, tails) -> list[str]:
        """The spans of a text; tails is tails_of, or a memo of it."""
        # four bytes are the longest character
        if len(text) * 4 < MOST_BYTES:
            spans = self.pattern.findall(text)
            return self._joined(spans, tails) if any(map(tails, spans)) else spans
        out: list[str] = []
        for part in sentences(text):
            spans = self.pattern.findall(part)
            out += self._joined(spans, tails) if any(map(tails, spans)) else spans
        return out
