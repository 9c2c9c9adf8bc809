"""Dictionaries: built from definition files, written to and read from folders, found by URI."""

import io
import os
import re
from collections import Counter
from collections.abc import Callable, Sequence
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kugiri.model import FORMAT_VERSION, SYSTEM, UNKNOWN, USER, AnalysisError, ErrorKind, Metadata, Schema
from kugiri.operators import badrows
from kugiri.operators.lattice import Trie
from kugiri.plans.rank import with_rank
from kugiri.sources.definitions import Categories, matrix_text, parse_matrix, parse_unknown

#: Detail normalization.
NORMAL = str.maketrans({"―": "—", "～": "〜"})
#: A lexicon loaded for segmentation has at most so many words, as every executor holds it.
MOST_WORDS = 20_000_000
UNK = ["UNK"]


def _integer(text: str, low: int, high: int) -> int | None:
    text = text.strip()
    return int(text) if re.fullmatch(r"[+-]?[0-9]{1,9}", text) and low <= int(text) <= high else None


class UserDictionary:
    """User words: entries by surface and details by id."""

    def __init__(self, rows: list[tuple[str, int, int, int, list[str]]]):
        self.rows = rows
        self.trie = Trie()
        for i, (surface, left, right, cost, _) in enumerate(rows):
            self.trie.add(surface, (left, right, cost, i))

    @classmethod
    def from_records(cls, records: list[list[str]], metadata: Metadata) -> "UserDictionary":
        """A record with exactly the user schema's fields takes default ids and cost; any other needs the whole schema."""
        simple, full = metadata.user_dictionary_schema, metadata.dictionary_schema
        _same_width(records, metadata.flexible_csv)
        rows = []
        for r in sorted(records, key=lambda r: r[0]):
            if not r[0] or "\0" in r[0]:
                raise AnalysisError(ErrorKind.BUILD, "a user word has no usable surface")
            if len(r) == len(simple.fields):
                details = [r[i] if (i := simple.index(name)) is not None and i < len(r) else metadata.default_field_value for name in full.custom_fields]
                rows.append((r[0], metadata.default_left_context_id, metadata.default_right_context_id, metadata.default_word_cost, details))
                continue
            numbers = [_integer(v, *span) for v, span in zip(r[1:4], ((0, 65535), (0, 65535), (-32768, 32767)))]
            if len(r) >= 4 and None in numbers:
                raise AnalysisError(ErrorKind.PARSE, f"user word {r[0]!r}: bad id or cost")
            if len(r) < len(full.fields):
                raise AnalysisError(ErrorKind.CONTENT, f"user word {r[0]!r}: {len(r)} fields instead of {len(simple.fields)} or {len(full.fields)}")
            rows.append((r[0], *numbers, r[4:]))
        return cls(rows)

    @classmethod
    def load(cls, uri: str, metadata: Metadata) -> "UserDictionary":
        """From a .csv, or from a built .parquet (or .bin) file."""
        path = _path(uri, embedded=False)
        if path.suffix == ".csv":
            return cls.from_records(read_records(path, metadata.encoding), metadata)
        if path.suffix in (".parquet", ".bin"):
            try:
                t = pq.read_table(path)
            except OSError as e:
                raise AnalysisError(ErrorKind.IO, str(e)) from e
            return cls(list(zip(*(t.column(c).to_pylist() for c in ("surface", "left_id", "right_id", "cost", "details")))))
        raise AnalysisError(ErrorKind.ARGS, f"{path}: a user dictionary is a .csv or .parquet file")

    def save(self, path: str | Path) -> None:
        columns = list(zip(*self.rows)) or [[]] * 5
        types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()))
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["surface", "left_id", "right_id", "cost", "details"]), path)

    def mapped(self, left: list[int], right: list[int]) -> "UserDictionary":
        """With context ids renamed as the system dictionary's were; ids out of range stay."""
        name = lambda ids, i: ids[i] if i < len(ids) else i
        return UserDictionary([(s, name(left, a), name(right, b), c, d) for s, a, b, c, d in self.rows])


def _same_width(records: list[list[str]], flexible: bool) -> None:
    if not flexible and len({len(r) for r in records}) > 1:
        raise AnalysisError(ErrorKind.CONTENT, "records differ in their number of fields")


def read_records(path: str | Path, encoding: str = "UTF-8") -> list[list[str]]:
    """The records of a headerless CSV file; a record that doesn't parse is a Content error."""
    try:
        text = Path(path).read_bytes().decode(encoding)
    except OSError as e:
        raise AnalysisError(ErrorKind.IO, str(e)) from e
    except LookupError as e:
        raise AnalysisError(ErrorKind.DECODE, f"unknown encoding {encoding}") from e
    except UnicodeError as e:
        raise AnalysisError(ErrorKind.DECODE, str(e)) from e
    out = []
    for record in badrows.parse_source(text.removeprefix("﻿")):
        if record.fields is None:
            raise AnalysisError(ErrorKind.CONTENT, f"{path}: broken quoting at character {record.error_at}")
        out.append(record.fields)
    return out


class Words(Sequence):
    """The words of a lexicon by id, as columns; each is (surface, left id, right id, cost, details), or None for a row without a word.

    Columns are shipped to the workers as they are, and a row is made only when it is asked for.
    """

    def __init__(self, surface: pa.Array, left: np.ndarray, right: np.ndarray, cost: np.ndarray, details: pa.Array):
        self.surface, self.left, self.right, self.cost, self.details = surface, left, right, cost, details

    @classmethod
    def of(cls, rows) -> "Words":
        if isinstance(rows, cls):
            return rows
        columns = list(zip(*(r or (None, 0, 0, 0, None) for r in rows))) or [[]] * 5
        return cls(pa.array(columns[0], pa.string()), *(np.array(c, np.int32) for c in columns[1:4]), pa.array(columns[4], pa.list_(pa.string())))

    @classmethod
    def from_table(cls, table: pa.Table) -> "Words":
        """From columns surface, left_id, right_id, cost and details in the order of the ids."""
        column = lambda name: table.column(name).combine_chunks()
        numbers = (pc.fill_null(column(n), 0).to_numpy(zero_copy_only=False).astype(np.int32) for n in ("left_id", "right_id", "cost"))
        return cls(column("surface").cast(pa.string()), *numbers, column("details"))

    def __len__(self) -> int:
        return len(self.surface)

    def __getitem__(self, i):
        if isinstance(i, slice):
            return [self[k] for k in range(*i.indices(len(self)))]
        surface = self.surface[i].as_py()
        return None if surface is None else (surface, int(self.left[i]), int(self.right[i]), int(self.cost[i]), self.details[i].as_py())

    def __iter__(self):
        for at in range(0, len(self), 10_000):
            part = slice(at, at + 10_000)
            for s, *rest in zip(self.surface[part].to_pylist(), self.left[part].tolist(), self.right[part].tolist(), self.cost[part].tolist(), self.details[part].to_pylist()):
                yield None if s is None else (s, *rest)

    def __eq__(self, other) -> bool:
        return len(self) == len(other) and all(a == b for a, b in zip(self, other))

    __hash__ = None

    def entry(self, i: int) -> tuple[int, int, int, int]:
        return int(self.left[i]), int(self.right[i]), int(self.cost[i]), i

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Left and right ids of the rows that are words."""
        there = self.surface.is_valid().to_numpy(zero_copy_only=False)
        return self.left[there], self.right[there]


class _Rows(dict):
    """Rows of the connection costs as lists, each made when first asked for."""

    def __init__(self, matrix: np.ndarray):
        super().__init__()
        self.matrix = matrix

    def __missing__(self, left: int) -> list[int]:
        row = self[left] = self.matrix[left].tolist()
        return row


class Dictionary:
    """What segmentation needs: categories, words, unknown words, connection costs, metadata."""

    def __init__(self, metadata: Metadata, char_def: str, unknown_rows, matrix: np.ndarray, words: Words | list[tuple[str, int, int, int, list[str]] | None], user: UserDictionary | None = None):
        self.metadata, self.schema = metadata, metadata.dictionary_schema
        self.char_def, self.unknown_rows, self.matrix, self.words = char_def, list(unknown_rows), matrix, Words.of(words)
        self.categories = Categories(char_def)
        self._index(user)

    def _index(self, user: UserDictionary | None) -> None:
        if len(self.words) > MOST_WORDS:
            raise AnalysisError(ErrorKind.DICTIONARY, f"more than {MOST_WORDS} words")
        self.system = Trie.of_rows(self.words.surface.to_pylist(), self.words.entry)
        names = self.categories.names
        self.unknown: list[list[tuple]] = [[] for _ in names]
        for i, (name, left, right, cost, _) in enumerate(self.unknown_rows):
            if name in names:
                self.unknown[names.index(name)].append((left, right, cost, i))
        for own in self.categories.by_edge:
            for c in own:
                if not self.unknown[c]:
                    raise AnalysisError(ErrorKind.DICTIONARY, f"category {names[c]} has no unknown word, so some texts have no path")
        self.costs = _Rows(self.matrix)
        backward, forward = self.matrix.shape
        left, right = self.words.ids()
        if any(e[0] >= backward or e[1] >= forward for own in self.unknown for e in own) or len(left) and (left.max() >= backward or right.max() >= forward):
            raise AnalysisError(ErrorKind.BUILD, "a context id lies outside the connection matrix")
        self.user_dictionary = user
        if user is not None and self.metadata.connection_id_mapping:
            m = self.metadata.connection_id_mapping
            user = user.mapped(m["left"], m["right"])
        if user is not None and any(r[1] >= backward or r[2] >= forward for r in user.rows):
            raise AnalysisError(ErrorKind.BUILD, "a user word's context id lies outside the connection matrix")
        self.user = user.trie if user is not None else None

    def __getstate__(self):
        return {"metadata": self.metadata, "char_def": self.char_def, "unknown_rows": self.unknown_rows, "matrix": self.matrix, "words": self.words, "user": self.user_dictionary}

    def __setstate__(self, state):
        self.__init__(**state)

    def with_user(self, user: UserDictionary | None) -> "Dictionary":
        return Dictionary(self.metadata, self.char_def, self.unknown_rows, self.matrix, self.words, user)

    def word_details(self, word_id: int, lex_type: str) -> list[str]:
        """Details of a word; those of an unknown id are UNK for user and unknown words, and none for system words."""
        if lex_type == SYSTEM:
            w = self.words[word_id] if 0 <= word_id < len(self.words) else None
            return w[4] if w else []
        rows = (self.user_dictionary.rows if self.user_dictionary else []) if lex_type == USER else self.unknown_rows
        return rows[word_id][4] if 0 <= word_id < len(rows) else UNK

    def find_surface(self, surface: str) -> list[tuple[int, int, int, int]]:
        """(left id, right id, cost, word id) of every entry of a surface."""
        return self.system.find(surface)

    def prefix(self, text: str) -> list[tuple[int, tuple[int, int, int, int]]]:
        """(end byte, entry) of every entry that is a prefix of the text."""
        return [(len(text[:end].encode()), e) for end, own in self.system.prefixes(text) for e in own]

    def common_prefixes(self, text: str) -> list[tuple[int, int]]:
        """(word id, end character) of every entry that is a prefix of the text."""
        return [(e[3], end) for end, own in self.system.prefixes(text) for e in own]

    # building -------------------------------------------------------------------------------------------------

    @classmethod
    def build(cls, metadata: Metadata, char_def: str, unk_def: str, matrix_def: str, records: list[list[str]]) -> "Dictionary":
        """From definition texts and lexicon records; the words' ids are their places in the order of surfaces."""
        _same_width(records, metadata.flexible_csv)
        normal = (lambda s: s.translate(NORMAL)) if metadata.normalize_details else (lambda s: s)
        place = {n: metadata.dictionary_schema.index(n) for n in ("surface", "left_context_id", "right_context_id", "cost")}
        value = lambda r, n: r[place[n]].strip() if place[n] is not None and place[n] < len(r) else ""
        words = []
        for r in sorted(records, key=lambda r: normal(r[0])):
            numbers = []
            for name, span in (("cost", (-32768, 32767)), ("left_context_id", (0, 65535)), ("right_context_id", (0, 65535))):
                text = value(r, name)
                n = _integer(text, *span) if text else None
                if text and n is None and not metadata.skip_invalid_cost_or_id:
                    raise AnalysisError(ErrorKind.CONTENT, f"word {r[0]!r}: invalid {name} {text!r}")
                numbers.append(n)
            surface = normal(value(r, "surface"))
            if "\0" in surface:
                raise AnalysisError(ErrorKind.BUILD, "a surface holds a NUL")
            # a row without a surface or a number is no entry but keeps its id
            words.append(None if None in numbers or not surface else (surface, numbers[1], numbers[2], numbers[0], [normal(x) for x in r[4:]]))
        return cls(metadata, char_def, parse_unknown(unk_def), parse_matrix(matrix_def), words)

    @classmethod
    def build_from_folder(cls, folder: str | Path, metadata: Metadata) -> "Dictionary":
        """From char.def, unk.def, matrix.def and all *.csv of a folder."""
        folder = Path(folder)

        def text(name: str) -> str:
            try:
                return (folder / name).read_bytes().decode(metadata.encoding)
            except OSError as e:
                raise AnalysisError(ErrorKind.IO, str(e)) from e
            except (LookupError, UnicodeError) as e:
                raise AnalysisError(ErrorKind.DECODE, f"{name}: {e}") from e

        records = [r for f in sorted(folder.glob("*.csv")) for r in read_records(f, metadata.encoding)]
        return cls.build(metadata, text("char.def"), text("unk.def"), text("matrix.def"), records)

    def remapped(self, left_counts: list[int] | None = None, right_counts: list[int] | None = None) -> "Dictionary":
        """With context ids renamed by falling frequency, id 0 kept; results stay the same.

        Without counts those of the lexicon's rows are taken. The mapping is kept for user words.
        """
        backward, forward = self.matrix.shape
        own = [w for w in self.words if w is not None]
        left = _permutation(left_counts or _histogram((w[1] for w in own), backward))
        right = _permutation(right_counts or _histogram((w[2] for w in own), forward))
        matrix = np.empty_like(self.matrix)
        matrix[np.ix_(left, right)] = self.matrix
        meta = Metadata(**{**self.metadata.__dict__, "connection_id_mapping": {"left": left, "right": right}})
        words = [w and (w[0], left[w[1]], right[w[2]], w[3], w[4]) for w in self.words]
        unknown = [(n, left[a], right[b], c, d) for n, a, b, c, d in self.unknown_rows]
        return Dictionary(meta, self.char_def, unknown, matrix, words, self.user_dictionary)

    # folders --------------------------------------------------------------------------------------------------

    def save(self, folder: str | Path, spark: SparkSession | None = None) -> None:
        """To a folder; with a session also to any place that its file systems reach."""
        files = _Folder(folder, spark)

        def put(name: str, table: pa.Table) -> None:
            sink = pa.BufferOutputStream()
            pq.write_table(table, sink)
            files.write(name, sink.getvalue().to_pybytes())

        files.write("metadata.json", self.metadata.to_json().encode())
        files.write("char.def", self.char_def.encode())
        matrix = io.BytesIO()
        np.save(matrix, self.matrix)
        files.write("matrix.npy", matrix.getvalue())
        kinds = [("left_id", pa.int32()), ("right_id", pa.int32()), ("cost", pa.int32()), ("details", pa.list_(pa.string()))]

        def write(name: str, first: str, rows) -> None:
            columns = list(zip(*rows)) or [[]] * 6
            put(name, pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), *(pa.array(c, t) for c, (_, t) in zip(columns[2:], kinds))], names=["word_id", first, *(k for k, _ in kinds)]))

        w = self.words
        number = lambda x: pa.array(x, pa.int32(), mask=w.surface.is_null().to_numpy(zero_copy_only=False))
        put("words.parquet", pa.table({"word_id": pa.array(np.arange(len(w)), pa.int64()), "surface": w.surface, "left_id": number(w.left), "right_id": number(w.right), "cost": number(w.cost), "details": w.details}))
        write("unknown.parquet", "category", [(i, *r) for i, r in enumerate(self.unknown_rows)])

    @classmethod
    def load(cls, folder: str | Path, spark: SparkSession | None = None) -> "Dictionary":
        files = _Folder(folder, spark)
        metadata = Metadata.from_json(files.read("metadata.json").decode())
        if metadata.format_version != FORMAT_VERSION:
            raise AnalysisError(ErrorKind.DESERIALIZE, f"format version {metadata.format_version}, not {FORMAT_VERSION}")
        try:
            table = lambda name: pq.read_table(pa.BufferReader(files.read(name))).sort_by("word_id")
            unknown = list(zip(*(c.to_pylist() for c in table("unknown.parquet").columns[1:])))
            return cls(metadata, files.read("char.def").decode(), unknown, np.load(io.BytesIO(files.read("matrix.npy"))), Words.from_table(table("words.parquet")))
        except (OSError, ValueError) as e:
            raise AnalysisError(ErrorKind.IO, str(e)) from e

    def export(self, folder: str | Path) -> None:
        """The definition texts and lexicon that build() reads."""
        folder = Path(folder)
        folder.mkdir(parents=True, exist_ok=True)
        cell = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\r\n') else v
        (folder / "lex.csv").write_text("".join(",".join(map(cell, [w[0], str(w[1]), str(w[2]), str(w[3]), *w[4]])) + "\n" for w in self.words if w), "utf-8")
        (folder / "unk.def").write_text("".join(",".join([n, str(a), str(b), str(c), *d]) + "\n" for n, a, b, c, d in self.unknown_rows), "utf-8")
        (folder / "char.def").write_text(self.char_def, "utf-8")
        (folder / "matrix.def").write_text(matrix_text(self.matrix), "utf-8")
        (folder / "metadata.json").write_text(self.metadata.to_json(), "utf-8")

    def details_table(self, spark: SparkSession) -> DataFrame:
        """lex_type, word_id and details of every word, for tokens that were made without details."""
        rows = [(SYSTEM, i, w[4]) for i, w in enumerate(self.words) if w is not None] + [(UNKNOWN, i, r[4]) for i, r in enumerate(self.unknown_rows)]
        rows += [(USER, i, r[4]) for i, r in enumerate(self.user_dictionary.rows)] if self.user_dictionary else []
        width = len(self.schema.custom_fields)
        return spark.createDataFrame([(k, i, [*d, *["*"] * (width - len(d))]) for k, i, d in rows], "lex_type string, word_id long, details array<string>")

    def words_table(self, spark: SparkSession) -> DataFrame:
        """The lexicon as a table, for joins on word_id and lookups by surface."""
        rows = [(i, *w) for i, w in enumerate(self.words) if w is not None]
        return spark.createDataFrame(rows, "word_id long, surface string, left_id int, right_id int, cost int, details array<string>")


def _histogram(ids, n: int) -> list[int]:
    counted = Counter(ids)
    return [counted[i] for i in range(n)]


def _permutation(counts: list[int]) -> list[int]:
    out = [0] * len(counts)
    for rank, old in enumerate(sorted(range(1, len(counts)), key=lambda i: (-counts[i], i)), 1):
        out[old] = rank
    return out


# tables ---------------------------------------------------------------------------------------------------------


def scan_lexicon(spark: SparkSession, path: str, metadata: Metadata) -> DataFrame:
    """The lexicon files as a table: word_id, surface, left_id, right_id, cost, details, reason.

    Rows are sorted by surface (the normalized one if the metadata say so), then by file and line; word_id is their place. A row
    that doesn't load keeps its id and has its reason; see operators.badrows.
    """
    lines = spark.read.option("encoding", metadata.encoding).text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).where(F.trim("line") != "")
    parsed = lines.withColumn("p", badrows.parse_column(F.col("line"), F.lit(len(metadata.dictionary_schema.fields)), F.lit(metadata.flexible_csv), F.lit(metadata.skip_invalid_cost_or_id)))
    normal = (lambda c: F.translate(c, "―～", "—〜")) if metadata.normalize_details else (lambda c: c)
    p = F.col("p")
    rows = parsed.select("file", "block", "at", normal(F.trim(p["fields"][0])).alias("surface"), p["left_id"].alias("left_id"), p["right_id"].alias("right_id"), p["cost"].alias("cost"), F.transform(F.slice(p["fields"], 5, F.greatest(F.size(p["fields"]) - 4, F.lit(0))), normal).alias("details"), p["reason"].alias("reason"))
    return with_rank(rows, ["surface", "file", "block", "at"], "word_id").drop("file", "block", "at")


def group_entries(words: DataFrame) -> DataFrame:
    """One row per surface with its entries in id order. A surface's entries are the readings of one word, so they are few."""
    return words.where("surface IS NOT NULL").groupBy("surface").agg(F.sort_array(F.collect_list(F.struct("word_id", "left_id", "right_id", "cost"))).alias("entries"))


def context_frequencies(words: DataFrame, side: str = "left_id") -> DataFrame:
    """Rows per context id, and the rank that remapping gives the id (0 stays 0)."""
    counts = words.where(F.col(side).isNotNull()).groupBy(side).agg(F.count("*").alias("n"))
    zero = counts.where(F.col(side) == 0).select(side, "n", F.lit(0).cast("long").alias("rank"))
    ranked = with_rank(counts.where(F.col(side) != 0), [F.desc("n"), F.asc(side)], "rank").select(side, "n", (F.col("rank") + 1).alias("rank"))
    return ranked.unionByName(zero)


def from_tables(lexicon: DataFrame, dictionaries: DataFrame, char_def: str, unknown_cost: int, connection: Callable | None = None) -> dict[str, Dictionary]:
    """A dictionary for each dict_name of the tables; word ids are places in the order of surfaces, as build() has them.

    The tables hold neither connection costs nor unknown words: an unknown word of any category costs `unknown_cost` and has UNK,
    and a connection costs what `connection` says of arrays of right ids (of the words before) and left ids (of those behind),
    by default 0. The lexicon comes to the driver, so it has at most MOST_WORDS words.
    """
    rows = lexicon.select("dict_name", "surface", "left_context_id", "right_context_id", "cost", "details").limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise AnalysisError(ErrorKind.DICTIONARY, f"more than {MOST_WORDS} words")
    own: dict[str, list] = {}
    for r in rows:
        own.setdefault(r.dict_name, []).append(r)
    out = {}
    for d in sorted(dictionaries.collect(), key=lambda d: d.dict_name):
        flags = {k: bool(d[k]) for k in ("flexible_csv", "skip_invalid_cost_or_id", "normalize_details")}
        meta = Metadata(d.dict_name, d.encoding, d.default_word_cost, d.default_left_context_id, d.default_right_context_id, d.default_field_value, **flags, dictionary_schema=Schema(tuple(d.dictionary_schema)), user_dictionary_schema=Schema(tuple(d.user_dictionary_schema)))
        normal = (lambda s: s.translate(NORMAL)) if meta.normalize_details else (lambda s: s)
        words = sorted((normal(r.surface), r.left_context_id, r.right_context_id, r.cost, [normal(x) for x in r.details]) for r in own.get(d.dict_name, ()))
        size = 1 + max((x for w in words for x in w[1:3]), default=0)
        unknown = parse_unknown("\n".join(f"{name},0,0,{unknown_cost},UNK" for name in Categories(char_def).names))
        out[d.dict_name] = Dictionary(meta, char_def, unknown, np.zeros((size, size), np.int16) if connection is None else np.asarray(connection(np.arange(size)[None, :], np.arange(size)[:, None]), np.int16), words)
    return out


class _Folder:
    """Files of a dictionary folder, local or, with a session, wherever Hadoop's file systems reach (an object store, HDFS)."""

    def __init__(self, folder: str | Path, spark: SparkSession | None):
        self.folder, self.spark = str(folder).rstrip("/"), spark

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def read(self, name: str) -> bytes:
        try:
            if self.spark is None:
                return (Path(self.folder) / name).read_bytes()
            path, system = self._hadoop(name)
            stream = system.open(path)
            try:
                return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()
        except (OSError, Py4JError) as e:
            raise AnalysisError(ErrorKind.IO, f"{self.folder}/{name}: {type(e).__name__}") from e

    def write(self, name: str, data: bytes) -> None:
        if self.spark is None:
            Path(self.folder).mkdir(parents=True, exist_ok=True)
            (Path(self.folder) / name).write_bytes(data)
            return
        path, system = self._hadoop(name)
        stream = system.create(path, True)
        stream.write(bytearray(data))
        stream.close()


# URIs -----------------------------------------------------------------------------------------------------------


def _path(uri: str, embedded: bool = True) -> Path:
    if "://" not in uri:
        return Path(uri)
    parsed = urlparse(uri)
    if parsed.scheme == "file":
        return Path(unquote(parsed.path))
    if parsed.scheme == "embedded" and not embedded:
        raise AnalysisError(ErrorKind.DICTIONARY, "no user dictionary is embedded")
    raise AnalysisError(ErrorKind.DICTIONARY, f"invalid dictionary scheme {parsed.scheme}")


def load_dictionary(uri: str, spark: SparkSession | None = None) -> Dictionary:
    """embedded://NAME (see kugiri.sources.bundled), file:///PATH or a path; with a session any URI of its file systems."""
    if uri.startswith("embedded://"):
        from kugiri.sources.bundled import bundled

        return bundled(uri.removeprefix("embedded://").strip("/"))
    if spark is not None and "://" in uri:
        return Dictionary.load(uri, spark)
    path = _path(uri)
    if not path.is_dir():
        raise AnalysisError(ErrorKind.IO, f"no dictionary folder {path}")
    return Dictionary.load(path)


def registry(folder: str | None = None) -> list[tuple[str, bool, bool, str]]:
    """Name, embedded, installed and path of all known dictionaries."""
    from kugiri.sources.bundled import BUNDLED

    folder = folder or os.environ.get("KUGIRI_DICTIONARIES", "")
    here = {p.name: str(p) for p in Path(folder).iterdir() if (p / "metadata.json").exists()} if folder and Path(folder).is_dir() else {}
    return [(n, n in BUNDLED, n in here, here.get(n, "")) for n in sorted({*BUNDLED, *here})]
