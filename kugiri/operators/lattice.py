"""Minimum-cost segmentation over a lattice of lexicon, user and unknown words, and its N best paths."""

import heapq
import re
from collections.abc import Iterator
from itertools import count

from kugiri.model import SYSTEM, UNKNOWN, USER, AnalysisError, ErrorKind, Mode

#: Path costs stay at or under this.
MOST_COST = 2**31 - 1 - 131072
#: A sentence is cut at the first character boundary at or after so many bytes.
MOST_BYTES = 32 * 1024
MOST_CHARS = 65535
PARTS = re.compile("[^\n\t。、]*[\n\t。、]|[^\n\t。、]+")


def sentences(text: str) -> Iterator[str]:
    """Parts of the text, each cut behind a line end, a tab, 。 or 、 or where it has MOST_BYTES."""
    for part in PARTS.findall(text):
        # four bytes are the longest character
        if len(part) * 4 < MOST_BYTES or len(part.encode("utf-8", "surrogatepass")) < MOST_BYTES:
            yield part
            continue
        start = size = 0
        for i, c in enumerate(part):
            if size >= MOST_BYTES:
                yield part[start:i]
                start, size = i, 0
            size += 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
        yield part[start:]


def is_kanji(c: str) -> bool:
    return "一" <= c <= "龯" or "㐀" <= c <= "䶿"


class Trie:
    """Common-prefix search; the entries of a surface stay in the order in which they were added.

    Surfaces are hashed whole, and for the first two characters the lengths that occur behind them are known, so a search tries
    few of a text's prefixes. Large lexicons keep row numbers here, from which entries are made when first found.
    """

    def __init__(self):
        self.own: dict[str, list | int] = {}
        self.lengths: dict[str, tuple[int, ...]] = {}
        self.entry = None

    @classmethod
    def of_rows(cls, surfaces: list[str | None], entry) -> "Trie":
        """From surfaces by row number (None for no word); entry makes a row's entry."""
        out = cls()
        out.entry, own = entry, out.own
        seen: dict[str, set[int]] = {}
        for i, s in enumerate(surfaces):
            if s is None:
                continue
            if (old := own.get(s)) is None:
                own[s] = i
                seen.setdefault(s[:2], set()).add(len(s))
            elif isinstance(old, int):
                own[s] = [entry(old), entry(i)]
            else:
                old.append(entry(i))
        shared: dict[tuple, tuple] = {}
        out.lengths = {k: shared.setdefault(t := tuple(sorted(v)), t) for k, v in seen.items()}
        return out

    def add(self, surface: str, entry: tuple) -> None:
        self.own.setdefault(surface, []).append(entry)
        old = self.lengths.get(surface[:2], ())
        if len(surface) not in old:
            self.lengths[surface[:2]] = tuple(sorted((*old, len(surface))))

    def holds(self, pattern: "re.Pattern") -> bool:
        """Whether a character of the pattern stands in a surface."""
        return any(map(pattern.match, set().union(*self.own)))

    def _found(self, surface: str) -> list[tuple] | None:
        got = self.own.get(surface)
        if isinstance(got, int):
            got = self.own[surface] = [self.entry(got)]
        return got

    def prefixes(self, text: str, at: int = 0) -> list[tuple[int, list[tuple]]]:
        """(end, entries) of every surface that text holds from `at`, the shortest first."""
        out, head = [], text[at : at + 2]
        if len(head) == 2 and (own := self._found(head[0])) is not None:
            out.append((at + 1, own))
        for n in self.lengths.get(head, ()):
            if at + n > len(text):
                break
            if (own := self._found(text[at : at + n])) is not None:
                out.append((at + n, own))
        return out

    def occurs(self, text: str) -> bool:
        """Whether the text holds a surface anywhere."""
        own, lengths = self.own, self.lengths
        for i, c in enumerate(text):
            if c in own:
                return True
            for n in lengths.get(text[i : i + 2], ()):
                if text[i : i + n] in own:
                    return True
        return False

    def find(self, surface: str) -> list[tuple]:
        return self._found(surface) or []


class Lattice:
    """Searches the sentences of one dictionary under one set of options.

    dictionary gives: categories, system and user (Trie of (left, right, cost, id)), unknown (entries by category), costs
    (rows of connection costs by the right word's left id).
    """

    def __init__(self, dictionary, mode: Mode = Mode(), max_grouping_len: int | None = None, ladder: bool = True):
        self.d, self.mode = dictionary, mode
        self.cap = max_grouping_len or None
        self.ladder = ladder
        self.kinds: dict[str, tuple[int, ...]] = {}

    def _kinds(self, text: str) -> list[tuple[int, ...]]:
        known, of = self.kinds, self.d.categories.of
        out = []
        for c in text:
            k = known.get(c)
            if k is None:
                k = known[c] = of(c)
            out.append(k)
        return out

    @staticmethod
    def _runs(kinds: list[tuple[int, ...]]) -> list[list[int]]:
        """For each character and ordinal, how many characters in a row have the same category at that ordinal."""
        out: list[list[int]] = [[]] * len(kinds)
        following, runs = (), []
        for i in range(len(kinds) - 1, -1, -1):
            own = kinds[i]
            if own == following and len(own) == 1:
                runs = [runs[0] + 1]
            else:
                runs = [runs[o] + 1 if o < len(following) and following[o] == c else 1 for o, c in enumerate(own)]
            out[i] = runs
            following = own
        return out

    def edges_at(self, text: str, i: int, kinds, runs, unknown_end: int) -> tuple[list[tuple[int, int, int, int, int, str]], int]:
        """Edges that start at i in the order that decides ties: (end, left, right, cost, id, type); and the new unknown_end."""
        d, out = self.d, []
        if d.user is not None:
            for end, own in reversed(d.user.prefixes(text, i)):
                out += [(end, *e, USER) for e in reversed(own)]
        for end, own in reversed(d.system.prefixes(text, i)):
            out += [(end, *e, SYSTEM) for e in reversed(own)]
        if self.mode.penalty is None and unknown_end > i:
            return out, unknown_end
        found, cats, n = bool(out), d.categories, len(text)
        for o, c in enumerate(kinds[i]):
            if found and not cats.invoke[c]:
                continue
            run = runs[i][o]
            size = 1
            if cats.group[c]:
                size = 1 if self.cap and run > 1 and run - 1 > self.cap else run
            entries = d.unknown[c]
            if entries:
                out += [(i + size, *e, UNKNOWN) for e in entries]
                if self.ladder and cats.length[c]:
                    for k in range(1, min(run, cats.length[c], n - i) + 1):
                        if k != size:
                            out += [(i + k, *e, UNKNOWN) for e in entries]
            unknown_end = i + size
        return out, unknown_end

    def best(self, text: str, before: int = 0, after: int = 0, ends_here: bool = True) -> tuple[list[tuple[int, int, int, str]], int]:
        """The cheapest path as (start, end, id, type), and its cost; an empty path for an empty text.

        before and after are the context ids between which the text stands, 0 at the ends of a sentence.
        """
        n = len(text)
        if n == 0:
            return [], 0
        if n >= MOST_CHARS:
            raise AnalysisError(ErrorKind.CONTENT, f"a sentence of {n} characters")
        kinds = self._kinds(text)
        runs = self._runs(kinds)
        costs, penalty = self.d.costs, self.mode.penalty
        # by end position: right id -> (cost with penalty, order, edge, cost)
        ends: list[dict | None] = [None] * (n + 1)
        ends[0] = {before: (0, 0, None, 0)}
        order = 0
        unknown_end = 0
        for i in range(n):
            lefts = ends[i]
            if lefts is None:
                continue
            edges, unknown_end = self.edges_at(text, i, kinds, runs, unknown_end)
            by_left: dict[int, tuple] = {}
            kanji = 0
            if penalty is not None:
                while i + kanji < n and is_kanji(text[i + kanji]):
                    kanji += 1
            single = next(iter(lefts.items())) if len(lefts) == 1 else None
            for end, left, right, cost, word, kind in edges:
                got = by_left.get(left)
                if got is None:
                    row = costs[left]
                    if single is not None:
                        r, x = single
                        got = (x[0] + row[r], x)
                    else:
                        low = tie = None
                        for r, x in lefts.items():
                            c = x[0] + row[r]
                            if low is None or c < low or c == low and x[1] < tie[1]:
                                low, tie = c, x
                        got = (low, tie)
                    by_left[left] = got
                path = got[0] + cost
                if path > MOST_COST:
                    path = MOST_COST
                order += 1
                # the last word of a sentence is not charged for its length
                charged = path if penalty is None or ends_here and end == n else min(MOST_COST, path + penalty.of(end - i, kanji >= end - i))
                there = ends[end]
                if there is None:
                    ends[end] = {right: (charged, order, (i, end, word, kind, got[1]), path)}
                else:
                    old = there.get(right)
                    if old is None or charged < old[0]:
                        there[right] = (charged, order, (i, end, word, kind, got[1]), path)
        final = ends[n]
        if final is None:
            raise AnalysisError(ErrorKind.DICTIONARY, "no path through the sentence")
        row = costs[after]
        low = tie = None
        for r, x in final.items():
            c = x[0] + row[r]
            if low is None or c < low or c == low and x[1] < tie[1]:
                low, tie = c, x
        out, x = [], tie
        while x[2] is not None:
            i, end, word, kind, before = x[2]
            out.append((i, end, word, kind))
            x = before
        return out[::-1], low

    def holds_word(self, text: str) -> bool:
        """Whether the text holds a lexicon or user word."""
        return self.d.system.occurs(text) or self.d.user is not None and self.d.user.occurs(text)

    def separators(self) -> "re.Pattern | None":
        """Runs that every path must take as one word, white space among them: then what stands between is independent.

        That holds for the runs of a category with one unknown word that groups without bound and ladder, whose characters have
        no other category and stand in no word. Only categories whose unknown word has the context ids of SPACE's are taken, so
        that all spans have equal neighbours; without such a SPACE there are none.
        """
        cats = self.d.categories
        tries = [t for t in (self.d.system, self.d.user) if t is not None]
        patterns = {}
        for k, name in enumerate(cats.names):
            if not cats.group[k] or cats.length[k] and self.ladder or self.cap or len(self.d.unknown[k]) != 1:
                continue
            ranges = [(low, high, own) for low, high, own in cats.rows() if name in own]
            if not ranges or any(len(own) > 1 for *_, own in ranges):
                continue
            pattern = "[" + "".join(f"{re.escape(chr(low))}-{re.escape(chr(high))}" for low, high, _ in ranges) + "]"
            if not any(t.holds(re.compile(pattern)) for t in tries):
                patterns[k] = pattern
        if cats.space not in patterns:
            return None
        ids = self.d.unknown[cats.space][0][:2]
        own = [p for k, p in patterns.items() if self.d.unknown[k][0][:2] == ids]
        # one look tells most characters of other categories apart
        return re.compile("((?=[" + "".join(p[1:-1] for p in own) + "])(?:" + "|".join(p + "+" for p in own) + "))")

    def paths(self, text: str, before: int = 0, after: int = 0) -> Iterator[tuple[list[tuple[int, int, int, str]], int]]:
        """All paths with their costs, the cheapest first: the forward costs guide a backward A* search. before and after as in best()."""
        n = len(text)
        if n == 0:
            return
        if n >= MOST_CHARS:
            raise AnalysisError(ErrorKind.CONTENT, f"a sentence of {n} characters")
        kinds = self._kinds(text)
        runs = self._runs(kinds)
        costs, penalty = self.d.costs, self.mode.penalty
        # a node: start, end, right id, word cost, word, type, path cost, penalty, [(left node, cost of the pair)]
        ends: list[list] = [[] for _ in range(n + 1)]
        ends[0] = [(0, 0, before, 0, None, None, 0, 0, ())]
        unknown_end = 0

        def node(lefts, left, start, end, right, cost, word, kind, charge, free=False):
            row = costs[left]
            pairs = [(x, x[6] + row[x[2]] + (0 if free else x[7])) for x in lefts]
            return start, end, right, cost, word, kind, min(MOST_COST, min(c for _, c in pairs) + cost), charge, pairs

        for i in range(n):
            if not ends[i]:
                continue
            edges, unknown_end = self.edges_at(text, i, kinds, runs, unknown_end)
            kanji = 0
            while penalty is not None and i + kanji < n and is_kanji(text[i + kanji]):
                kanji += 1
            for end, left, right, cost, word, kind in edges:
                charge = penalty.of(end - i, kanji >= end - i) if penalty is not None else 0
                ends[end].append(node(ends[i], left, i, end, right, cost, word, kind, charge))
        if not ends[n]:
            raise AnalysisError(ErrorKind.DICTIONARY, "no path through the sentence")
        eos = node(ends[n], after, n, n, 0, 0, None, None, 0, True)
        serial = count()
        heap = [(eos[6], next(serial), 0, eos, None)]
        while heap:
            f, _, g, x, tail = heapq.heappop(heap)
            if not x[8]:
                path = []
                while tail is not None:
                    path.append(tail[0])
                    tail = tail[1]
                yield path, f
                continue
            rest = tail if x[4] is None else ((x[0], x[1], x[4], x[5]), tail)
            for left, pair in x[8]:
                own = g + pair - left[6] + x[3]
                heapq.heappush(heap, (left[6] + own, next(serial), own, left, rest))

    def nbest(self, text: str, n: int, unique: bool = False, threshold: int | None = None) -> list[tuple[list, int]]:
        """Up to n paths; unique keeps one path for each set of boundaries, threshold bounds the distance to the best."""
        out, seen, least = [], set(), None
        if n <= 0:
            return out
        for path, cost in self.paths(text):
            least = cost if least is None else least
            if threshold is not None and cost > least + threshold:
                break
            if unique:
                key = tuple(p[0] for p in path)
                if key in seen:
                    continue
                seen.add(key)
            out.append((path, cost))
            if len(out) == n:
                break
        return out
