"""A conditional random field over word lattices: loss and gradient by forward-backward, minimized by L-BFGS or OWL-QN.

A label has unigram features, and left and right bigram features: those count when the word stands on the left or on the right
of a pair. Lattices may lie in an RDD; then every evaluation is one pass whose partial sums meet in a tree.
"""

from array import array
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from itertools import batched

import numpy as np
from pyspark import StorageLevel

from kugiri.model import AnalysisError, ErrorKind

EPSILON = np.finfo(float).eps
#: Lattices that are evaluated together.
TOGETHER = 1024


@dataclass
class FeatureSet:
    """Feature ids from 1; a bigram feature may be missing."""

    unigram: list[int]
    right: list[int | None]
    left: list[int | None]


@dataclass
class Lattice:
    """Words over n places: (start, target, label). The first word at each place that the correct path passes is correct."""

    n: int
    nodes: list[list[tuple[int, int]]] = field(default_factory=list)

    def __post_init__(self):
        if self.n < 1:
            raise AnalysisError(ErrorKind.ARGS, "a lattice has at least one place")
        self.nodes = self.nodes or [[] for _ in range(self.n)]

    def add(self, start: int, target: int, label: int) -> None:
        if not 0 <= start < target <= self.n:
            raise AnalysisError(ErrorKind.ARGS, f"no word from {start} to {target} of {self.n}")
        self.nodes[start].append((target, label))


def _sets(sets: list[FeatureSet], label: int) -> FeatureSet | None:
    return sets[label - 1] if 0 < label <= len(sets) else None


def bigrams(sets: list[FeatureSet], left: int | None, right: int | None) -> list[tuple[int, int]]:
    """Feature pairs of two labels; None is the sentence's edge, which is feature 0."""
    a, b = (None if x is None else _sets(sets, x) for x in (left, right))
    if left is None:
        return [(0, r) for r in b.right if r] if b else []
    if right is None:
        return [(x, 0) for x in a.left if x] if a else []
    return [(x, y) for x, y in zip(a.left, b.right) if x and y] if a and b else []


@dataclass
class Weights:
    """Where each feature's weight is."""

    unigram: dict[int, int] = field(default_factory=dict)
    bigram: dict[tuple[int, int], int] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.unigram) + len(self.bigram)


def pairs_of(lattice: Lattice) -> Iterable[tuple[int | None, int | None]]:
    """Neighbouring labels, with those at the sentence's edges."""
    for _, label in lattice.nodes[0]:
        yield None, label
    for own in lattice.nodes:
        for target, label in own:
            if target == lattice.n:
                yield label, None
            else:
                for _, following in lattice.nodes[target]:
                    yield label, following


def features_of(lattices: Iterable[Lattice], sets: list[FeatureSet]) -> tuple[set[int], set[tuple[int, int]]]:
    uni, bi, seen = set(), set(), set()
    for lattice in lattices:
        for own in lattice.nodes:
            for _, label in own:
                if (s := _sets(sets, label)) is not None:
                    uni.update(s.unigram)
        for pair in pairs_of(lattice):
            if pair not in seen:
                seen.add(pair)
                bi.update(bigrams(sets, *pair))
    return uni, bi


class Compiled:
    """A lattice with the places of its weights."""

    def __init__(self, lattice: Lattice, sets: list[FeatureSet], weights: Weights):
        edges = [(i, t, label) for i, own in enumerate(lattice.nodes) for t, label in own]
        at = [[k for k, e in enumerate(edges) if e[0] == i] for i in range(lattice.n)] if len(edges) < 64 else self._by_start(edges, lattice.n)
        self.n_edges = len(edges)
        self.starts = np.array([e[0] for e in edges])
        self.edge_of, self.edge_weight = self._flat([[weights.unigram[f] for f in s.unigram if f in weights.unigram] if (s := _sets(sets, e[2])) else [] for e in edges])
        a, b, places = [], [], []
        known: dict = {}

        def pair(x: int, y: int) -> None:
            key = (edges[x][2] if x >= 0 else None, edges[y][2] if y >= 0 else None)
            if key not in known:
                known[key] = [weights.bigram[f] for f in bigrams(sets, *key) if f in weights.bigram]
            a.append(x)
            b.append(y)
            places.append(known[key])

        for k in at[0]:
            pair(-1, k)
        for k, (_, target, _) in enumerate(edges):
            if target == lattice.n:
                pair(k, -1)
            else:
                for following in at[target]:
                    pair(k, following)
        self.a, self.b = np.array(a), np.array(b)
        self.pair_of, self.pair_weight = self._flat(places)
        # the pairs into each place, and out of it, in the order of places
        starts = np.where(self.b >= 0, self.starts[self.b], lattice.n)
        self.into = [np.flatnonzero(starts == i) for i in range(lattice.n + 1)]
        gold, i, before = [], 0, -1
        index = {(x, y): k for k, (x, y) in enumerate(zip(a, b))}
        while i < lattice.n:
            if not at[i]:
                raise AnalysisError(ErrorKind.ARGS, "the correct path breaks off")
            k = at[i][0]
            gold.append((index[before, k], k))
            i, before = edges[k][1], k
        self.gold_pairs = np.array([p for p, _ in gold] + [index[before, -1]])
        self.gold_edges = np.array([k for _, k in gold])

    @staticmethod
    def _by_start(edges, n):
        out = [[] for _ in range(n)]
        for k, e in enumerate(edges):
            out[e[0]].append(k)
        return out

    @staticmethod
    def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([v for x in lists for v in x], np.int64)

    def evaluate(self, w: np.ndarray, gradient: np.ndarray | None) -> float:
        """Minus the log-likelihood of the correct path; its gradient is added to `gradient`."""
        edge = np.bincount(self.edge_of, w[self.edge_weight], self.n_edges) if len(self.edge_of) else np.zeros(self.n_edges)
        pair = np.bincount(self.pair_of, w[self.pair_weight], len(self.a)) if len(self.pair_of) else np.zeros(len(self.a))
        alpha = np.append(np.full(self.n_edges, -np.inf), 0.0)
        z = -np.inf
        for i, own in enumerate(self.into):
            if not len(own):
                continue
            inward, to = alpha[self.a[own]] + pair[own], self.b[own]
            if i == len(self.into) - 1:
                z = np.logaddexp.reduce(inward)
            else:
                np.logaddexp.at(alpha, to, inward)
                done = np.unique(to)
                alpha[done] += edge[done]
        if gradient is not None:
            beta = np.append(np.full(self.n_edges, -np.inf), 0.0)
            score = np.append(edge, 0.0)
            for own in reversed(self.into):
                if len(own):
                    np.logaddexp.at(beta[:-1], *self._outward(own, pair, score, beta))
            p = np.exp(alpha[self.a] + pair + score[self.b] + np.where(self.b >= 0, beta[self.b], 0.0) - z)
            p[self.gold_pairs] -= 1
            q = np.exp(alpha[:-1] + beta[:-1] - z)
            q[self.gold_edges] -= 1
            np.add.at(gradient, self.pair_weight, p[self.pair_of])
            np.add.at(gradient, self.edge_weight, q[self.edge_of])
        return z - pair[self.gold_pairs].sum() - edge[self.gold_edges].sum()

    def _outward(self, own, pair, score, beta):
        own = own[self.a[own] >= 0]
        b = self.b[own]
        return self.a[own], pair[own] + score[b] + np.where(b >= 0, beta[b], 0.0)


class Batch:
    """Many lattices with the places of their weights, evaluated together place by place; loss and gradient are the sums of Compiled's.

    Nodes are all words, then each lattice's end, then the common beginning. Scores are looked up by label and by pair of labels.
    """

    def __init__(self, lattices: Iterable[Lattice], sets: list[FeatureSet], weights: Weights):
        labels: dict[int, int] = {}
        kinds: dict[tuple[int | None, int | None], int] = {}
        label, owner, level, a, b, kind, gold, gold_words = (array("i") for _ in range(8))
        ends = array("i")
        for j, lattice in enumerate(lattices):
            at = []
            for own in lattice.nodes:
                at.append((len(label), own))
                for _, x in own:
                    label.append(labels.setdefault(x, len(labels)))
                    owner.append(j)
            correct, i = set(), 0
            while i < lattice.n:
                if not lattice.nodes[i]:
                    raise AnalysisError(ErrorKind.ARGS, "the correct path breaks off")
                correct.add(at[i][0])
                i = lattice.nodes[i][0][0]
            gold_words.extend(sorted(correct))

            def pairs(place: int, before: int, left: int | None) -> None:
                """The pairs of a word, or the beginning, with what starts at the place."""
                if place == lattice.n:
                    following = ((-1 - j, None),)
                else:
                    first, own = at[place]
                    following = ((first + k, x) for k, (_, x) in enumerate(own))
                right = before < 0 or before in correct
                for k, x in following:
                    level.append(place)
                    a.append(before)
                    b.append(k)
                    kind.append(kinds.setdefault((left, x), len(kinds)))
                    gold.append(right and (k < 0 or k in correct))

            pairs(0, -1, None)
            for first, own in at:
                for k, (target, x) in enumerate(own, first):
                    pairs(target, k, x)
            ends.append(j)
        n, self.lattices = len(label), len(ends)
        self.size = n + self.lattices + 1
        numbers = lambda x: np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32)
        a, b, level = numbers(a), numbers(b), numbers(level)
        a, b = np.where(a < 0, self.size - 1, a), np.where(b < 0, n - 1 - b, b)
        order = np.lexsort((b, level))
        self.a, self.b, self.kind = (x[order].astype(np.int32) for x in (a, b, numbers(kind)))
        self.gold_pairs = np.flatnonzero(numbers(gold)[order])
        self.label, self.owner, self.gold_words = numbers(label).copy(), np.append(numbers(owner), numbers(ends)), numbers(gold_words).copy()
        cuts = np.flatnonzero(np.diff(level[order], prepend=-1)).tolist()
        self.forward, self.backward = [], []
        for low, high in zip(cuts, [*cuts[1:], len(order)]):
            self.forward.append((low, high, *self._groups(self.b[low:high])))
            by = low + np.argsort(self.a[low:high], kind="stable")
            self.backward.append((by.astype(np.int32), *self._groups(self.a[by])))
        self.n_labels, self.n_kinds = len(labels), len(kinds)
        self.label_of, self.label_weight = Compiled._flat([[weights.unigram[f] for f in s.unigram if f in weights.unigram] if (s := _sets(sets, x)) else [] for x in labels])
        self.kind_of, self.kind_weight = Compiled._flat([[weights.bigram[f] for f in bigrams(sets, *x) if f in weights.bigram] for x in kinds])

    @staticmethod
    def _groups(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each run of equal nodes begins, and the nodes."""
        heads = np.flatnonzero(np.diff(nodes, prepend=-1))
        return heads, nodes[heads]

    def evaluate(self, w: np.ndarray, gradient: np.ndarray | None) -> float:
        """Minus the log-likelihood of the correct paths; its gradient is added to `gradient`."""
        n, a, b = len(self.label), self.a, self.b
        score = np.zeros(self.size)
        score[:n] = np.bincount(self.label_of, w[self.label_weight], self.n_labels)[self.label]
        pair = np.bincount(self.kind_of, w[self.kind_weight], self.n_kinds)[self.kind]
        alpha = np.full(self.size, -np.inf)
        alpha[-1] = 0.0
        for low, high, heads, nodes in self.forward:
            alpha[nodes] = np.logaddexp.reduceat(alpha[a[low:high]] + pair[low:high], heads) + score[nodes]
        z = alpha[n:-1]
        if gradient is not None:
            beta = np.full(self.size, -np.inf)
            beta[n:-1] = 0.0
            for by, heads, nodes in reversed(self.backward):
                to = b[by]
                beta[nodes] = np.logaddexp.reduceat(pair[by] + score[to] + beta[to], heads)
            p = np.exp(alpha[a] + pair + score[b] + beta[b] - z[self.owner[b]])
            p[self.gold_pairs] -= 1
            q = np.exp(alpha[:n] + beta[:n] - z[self.owner[:n]])
            q[self.gold_words] -= 1
            np.add.at(gradient, self.kind_weight, np.bincount(self.kind, p, self.n_kinds)[self.kind_of])
            np.add.at(gradient, self.label_weight, np.bincount(self.label, q, self.n_labels)[self.label_of])
        return float(z.sum() - pair[self.gold_pairs].sum() - score[self.gold_words].sum())


@dataclass
class Model:
    """Trained weights of the features that have any."""

    sets: list[FeatureSet]
    unigram: dict[int, float]
    bigram: dict[tuple[int, int], float]

    def word_score(self, label: int) -> float:
        s = _sets(self.sets, label)
        return sum(self.unigram.get(f, 0.0) for f in s.unigram) if s else 0.0

    def pair_score(self, left: int | None, right: int | None) -> float:
        return sum(self.bigram.get(f, 0.0) for f in bigrams(self.sets, left, right))

    def merge(self) -> "Merged":
        """One id for every distinct set of bigram features, and the scores of all pairs of ids."""
        lefts: dict[tuple, int] = {}
        rights: dict[tuple, int] = {}
        out = []
        for i, s in enumerate(self.sets, 1):
            out.append((self.word_score(i), lefts.setdefault(tuple(s.right), len(lefts) + 1), rights.setdefault(tuple(s.left), len(rights) + 1)))
        matrix: list[dict[int, float]] = [{} for _ in range(len(rights) + 1)]
        for own, left in lefts.items():
            matrix[0][left] = sum(self.bigram.get((0, f), 0.0) for f in own if f)
        for own, right in rights.items():
            matrix[right][0] = sum(self.bigram.get((f, 0), 0.0) for f in own if f)
            for other, left in lefts.items():
                matrix[right][left] = sum(self.bigram.get((x, y), 0.0) for x, y in zip(own, other) if x and y)
        matrix = [{k: v for k, v in row.items() if abs(v) >= EPSILON} for row in matrix]
        return Merged(out, matrix, [list(x) for x in lefts], [list(x) for x in rights])

    def best_path(self, lattice: Lattice) -> tuple[list[tuple[int, int, int]], float]:
        return _best_path(lattice, self.word_score, self.pair_score)


@dataclass
class Merged:
    """Words as (weight, left id, right id), and connection weights by right id and left id; id 0 is the sentence's edge."""

    words: list[tuple[float, int, int]]
    matrix: list[dict[int, float]]
    left_features: list[list]
    right_features: list[list]

    def best_path(self, lattice: Lattice) -> tuple[list[tuple[int, int, int]], float]:
        own = lambda k: self.words[k - 1] if 0 < k <= len(self.words) else (0.0, -1, len(self.matrix))
        right = lambda k: 0 if k is None else own(k)[2]
        left = lambda k: 0 if k is None else own(k)[1]
        return _best_path(lattice, lambda k: own(k)[0], lambda a, b: self.matrix[right(a)].get(left(b), 0.0) if right(a) < len(self.matrix) else 0.0)

    def cost_factor(self) -> int:
        """The factor that takes the greatest weight to the end of the 16-bit range."""
        most = max([abs(w) for w, _, _ in self.words] + [abs(v) for row in self.matrix for v in row.values()], default=0.0)
        return int(32767 / most) if most > EPSILON else 700


def _best_path(lattice: Lattice, word: Callable, pair: Callable) -> tuple[list[tuple[int, int, int]], float]:
    """The path of greatest score as (start, target, label), searched from the end; the first of equals wins."""
    best: list[list[tuple]] = [[] for _ in range(lattice.n + 1)]
    for i in range(lattice.n - 1, -1, -1):
        for target, label in lattice.nodes[i]:
            if target == lattice.n:
                best[i].append((word(label) + pair(label, None), target, label, None))
                continue
            top = None
            for x in best[target]:
                s = x[0] + pair(label, x[2])
                if top is None or s > top[0]:
                    top = (s, x)
            if top is not None:
                best[i].append((top[0] + word(label), target, label, top[1]))
    top = None
    for x in best[0]:
        s = x[0] + pair(None, x[2])
        if top is None or s > top[0]:
            top = (s, x)
    if top is None:
        raise AnalysisError(ErrorKind.ARGS, "no path through the lattice")
    out, at, x = [], 0, top[1]
    while x is not None:
        out.append((at, x[1], x[2]))
        at, x = x[1], x[3]
    return out, top[0]


def minimize(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, l1: float = 0.0, most: int = 100, memory: int = 7, tolerance: float = 1e-7) -> np.ndarray:
    """The minimum of objective(w) + l1 * |w|: L-BFGS, orthant-wise where l1 > 0, with Armijo backtracking."""
    x = start.copy()
    f, g = objective(x)
    f += l1 * np.abs(x).sum()
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for step in range(most):
        # steepest descent of the objective with its kinks
        low = np.where(x != 0, g + l1 * np.sign(x), np.where(g + l1 < 0, g + l1, np.where(g - l1 > 0, g - l1, 0.0))) if l1 else g
        if np.abs(low).max(initial=0.0) < tolerance:
            break
        d, alphas = -low, []
        for s, y, rho in reversed(past):
            alphas.append(rho * s.dot(d))
            d = d - alphas[-1] * y
        if past:
            s, y, _ = past[-1]
            d = d * (s.dot(y) / y.dot(y))
        for (s, y, rho), a in zip(past, reversed(alphas)):
            d = d + (a - rho * y.dot(d)) * s
        if l1:
            d = np.where(d * low < 0, d, 0.0)
        if d.dot(low) >= 0:
            d, past = -low, []
        orthant = np.where(x != 0, np.sign(x), -np.sign(low))
        size = 1.0 if past else 1.0 / max(1.0, float(np.sqrt(low.dot(low))))
        for _ in range(40):
            new = x + size * d
            if l1:
                new = np.where(new * orthant > 0, new, 0.0)
            value, gradient = objective(new)
            value += l1 * np.abs(new).sum()
            if value <= f + 1e-4 * low.dot(new - x):
                break
            size *= 0.5
        else:
            break
        s, y = new - x, gradient - g
        done = abs(f - value) <= tolerance * max(1.0, abs(f))
        x, f, g = new, value, gradient
        if s.dot(y) > 1e-12:
            past = [*past, (s, y, 1.0 / s.dot(y))][-memory:]
        if done:
            break
    return x


@dataclass
class CrfTrainer:
    """regularization: l1, l2 or elastic_net with the share l1_ratio."""

    regularization: str = "l1"
    cost: float = 0.1
    l1_ratio: float = 0.5
    max_iter: int = 100
    partitions: int | None = None

    def __post_init__(self):
        if self.regularization not in ("l1", "l2", "elastic_net") or self.cost < 0 or not 0 <= self.l1_ratio <= 1 or self.max_iter < 1 or (self.partitions is not None and self.partitions < 1):
            raise AnalysisError(ErrorKind.ARGS, f"bad trainer arguments {self}")

    def train(self, lattices, sets: list[FeatureSet]) -> Model:
        """lattices: a list, or an RDD of lattices, which stays distributed."""
        spread = hasattr(lattices, "mapPartitions")
        if spread:
            uni, bi = lattices.mapPartitions(lambda own: [features_of(own, sets)]).treeReduce(lambda x, y: (x[0] | y[0], x[1] | y[1]))
        else:
            uni, bi = features_of(lattices, sets)
        # places by sorted features, so that they don't depend on the partitions
        weights = Weights({f: i for i, f in enumerate(sorted(uni))}, {f: i + len(uni) for i, f in enumerate(sorted(bi))})
        n = len(weights)
        share = {"l1": 1.0, "l2": 0.0, "elastic_net": self.l1_ratio}[self.regularization]
        l2 = self.cost * (1 - share)

        def total(own, w: np.ndarray) -> tuple[float, np.ndarray]:
            g, loss = np.zeros(n), 0.0
            for c in own:
                loss += c.evaluate(w, g)
            return loss, g

        if spread:
            context = lattices.context
            compiled = lattices.mapPartitions(lambda own: (Batch(some, sets, weights) for some in batched(own, TOGETHER))).persist(StorageLevel.MEMORY_AND_DISK)

            def data(w: np.ndarray) -> tuple[float, np.ndarray]:
                sent = context.broadcast(w)
                out = compiled.mapPartitions(lambda own: [total(own, sent.value)]).treeReduce(lambda x, y: (x[0] + y[0], x[1] + y[1]))
                sent.unpersist()
                return out
        else:
            compiled = [Batch(some, sets, weights) for some in batched(lattices, TOGETHER)]
            data = lambda w: total(compiled, w)

        def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
            loss, g = data(w)
            return loss + 0.5 * l2 * w.dot(w), g + l2 * w

        w = minimize(objective, np.zeros(n), self.cost * share, self.max_iter)
        if spread:
            compiled.unpersist()
        keep = lambda where: {f: float(w[i]) for f, i in where.items() if abs(w[i]) >= EPSILON}
        unigram, bigram = keep(weights.unigram), keep(weights.bigram)
        lefts, rights = {x for x, _ in bigram}, {y for _, y in bigram}
        pruned = [FeatureSet([f for f in s.unigram if f in unigram], [f if f in rights else None for f in s.right], [f if f in lefts else None for f in s.left]) for s in sets]
        return Model(pruned, unigram, bigram)
