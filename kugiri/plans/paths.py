"""Queries of the lattice search with the words of the lexicon table, over all neighbouring words of the training corpus written
together and over all user words with their readings, and the SQL that checks them.

A path's cost is compared, which says the same whichever of several paths of one cost is taken.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kugiri.model import Penalty
from kugiri.plans.analyzer import Segmenter, Tokenizer
from kugiri.plans.shared import read, spread
from kugiri.plans.skew import join_table
from kugiri.sources.bundled import _SCRIPTS, char_def
from kugiri.sources.dictionary import MOST_WORDS, Dictionary, UserDictionary, from_tables

#: As no cost in the lexicon table is higher, a word mostly wins over the same text as an unknown word.
UNKNOWN_COST = 10_000
#: Distance from the cheapest path in nbest_threshold.
THRESHOLD = 6_000
SURFACE = "`東京スカイツリー`"
#: Texts by name: table, id and text, as Spark and the checking SQL both read it; a NULL part makes no text.
_NEXT = "OVER (PARTITION BY dict_name, sentence_id ORDER BY word_pos, row_id)"
TEXTS = {
    "joined": ("user_words", "entry_id", "concat({0}, reading)", SURFACE),
    "pairs": ("corpus_words", "row_id", f"surface || lead(surface) {_NEXT}", ""),
    "triples": ("corpus_words", "row_id", f"surface || lead(surface) {_NEXT} || lead(surface, 2) {_NEXT}", ""),
}


def connection(right, left):
    """A made-up connection cost of a word's right id and the next word's left id, as the tables have none."""
    return (right * 37 + left * 53) % 211 - 60


def dictionaries(spark: SparkSession, d: str, users: bool = False, connected: bool = True) -> dict[str, Dictionary]:
    """The dictionaries of the lexicon table; with all user words of their own on request."""
    out = from_tables(read(spark, d, "lexicon"), read(spark, d, "dictionaries"), char_def(), UNKNOWN_COST, connection if connected else None)
    if not users:
        return out
    rows = read(spark, d, "user_words").where(f"{SURFACE} <> ''").select("dict_name", F.expr(SURFACE).alias("s")).limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} user words")
    own: dict[str, list[str]] = {}
    for r in rows:
        own.setdefault(r.dict_name, []).append(r.s)
    meta = lambda x: (x.metadata.default_left_context_id, x.metadata.default_right_context_id, x.metadata.default_word_cost)
    return {n: x.with_user(UserDictionary([(s, *meta(x), ["*"]) for s in sorted(own.get(n, ()))])) for n, x in out.items()}


def _texts(spark: SparkSession, d: str, name: str) -> DataFrame:
    table, id, text, surface = TEXTS[name]
    return spread(read(spark, d, table).select(F.col(id).alias("id"), "dict_name", F.expr(text.format(surface)).alias("text")).where("text IS NOT NULL"))


def _words(spark: SparkSession, dictionary: Dictionary) -> DataFrame:
    """lex_type, word_id, ids and cost of every word."""
    rows = [("System", i, *w[1:4]) for i, w in enumerate(dictionary.words) if w is not None] + [("Unknown", i, *r[1:4]) for i, r in enumerate(dictionary.unknown_rows)]
    rows += [("User", i, *r[1:4]) for i, r in enumerate(dictionary.user_dictionary.rows)] if dictionary.user_dictionary else []
    return spark.createDataFrame(rows, "lex_type string, word_id long, left_id int, right_id int, cost int")


def path_costs(tokens: DataFrame, words: DataFrame, id: str, penalty: Penalty | None = None) -> DataFrame:
    """The cost of each text's path, white space included: words, connections, and penalties of all words but a sentence's last."""
    w = Window.partitionBy(id).orderBy("byte_start")
    j = join_table(tokens.select(id, "byte_start", "surface", "lex_type", "word_id"), words, ["lex_type", "word_id"])
    j = j.withColumn("ends", F.col("surface").rlike("[\n\t。、]$") | F.lead("cost").over(w).isNull())
    before = F.when(F.coalesce(F.lag("ends").over(w), F.lit(True)), 0).otherwise(F.lag("right_id").over(w))
    cost = F.col("cost") + connection(before, F.col("left_id")) + F.when(F.col("ends"), connection(F.col("right_id"), F.lit(0))).otherwise(0)
    if penalty is not None:
        n = F.char_length("surface")
        kanji, other = penalty.kanji_penalty_length_threshold, penalty.other_penalty_length_threshold
        charged = F.when(n <= kanji, 0).when(F.col("surface").rlike("^[一-龯㐀-䶿]+$"), (n - kanji) * penalty.kanji_penalty_length_penalty).when(n > other, (n - other) * penalty.other_penalty_length_penalty).otherwise(0)
        cost = cost + F.when(F.col("ends"), 0).otherwise(charged)
    return j.select(id, cost.cast("long").alias("c"), F.octet_length("surface").alias("b")).groupBy(id).agg(F.sum("c").alias("cost"), F.sum("b").alias("bytes"))


def _segmented(text: str, users: bool = False, mode: str = "normal"):
    def query(spark: SparkSession, d: str) -> DataFrame:
        texts, parts = _texts(spark, d, text), []
        for name, dictionary in dictionaries(spark, d, users).items():
            chain = Tokenizer(Segmenter(dictionary, mode, keep_whitespace=True))
            tokens = chain.tokenize_rows(texts.where(F.col("dict_name") == name).select("id", "text"), "text", details=False)
            parts.append(path_costs(tokens, _words(spark, dictionary), "id", chain.segmenter.mode.penalty))
        return reduce(DataFrame.unionAll, parts)

    return query


def _nbest(n: int = 3, unique: bool = False, threshold: int | None = None):
    def query(spark: SparkSession, d: str) -> DataFrame:
        texts, parts = _texts(spark, d, "pairs"), []
        for name, dictionary in dictionaries(spark, d, connected=not unique).items():
            chain = Tokenizer(Segmenter(dictionary, keep_whitespace=True))
            parts.append(chain.nbest_rows(texts.where(F.col("dict_name") == name).select("id", "text"), "text", n, unique, threshold).select("id", "rank", "cost"))
        return reduce(DataFrame.unionAll, parts)

    return query


QUERIES = {
    "segmented": _segmented("triples"),
    "segmented_user": _segmented("joined", users=True),
    "segmented_decomposed": _segmented("triples", mode="decompose"),
    "nbest_costs": _nbest(),
    "nbest_threshold": _nbest(threshold=THRESHOLD),
    "nbest_unique": _nbest(unique=True),
}


# SQL: shortest paths, position by position -----------------------------------------------------------------------


def _class(name: str) -> str:
    return "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in _SCRIPTS[name][1])


def _sql(texts: str, result: str, users: bool = False, decompose: bool = False, n: int = 1, connected: bool = True, unique: bool = False) -> str:
    named = [x for x in _SCRIPTS if x != "DEFAULT"]
    runs = "|".join([f"[{_class(x)}]+" for x in named] + [f"[^{''.join(map(_class, named))}]+"])
    invoked = "".join(_class(x) for x in named if _SCRIPTS[x][0][0])
    user = 'UNION ALL SELECT dict_name, "東京スカイツリー", default_left_context_id, default_right_context_id, default_word_cost FROM user_words JOIN dictionaries USING (dict_name) WHERE "東京スカイツリー" <> \'\'' if users else ""
    length = "(e.j - e.i)"
    penalty = f"CASE WHEN e.j = e.n + 1 OR {length} <= 2 THEN 0 WHEN regexp_full_match(substr(e.s, e.i, {length}), '[一-龯㐀-䶿]+') THEN ({length} - 2) * 3000 WHEN {length} > 7 THEN ({length} - 7) * 1700 ELSE 0 END" if decompose else "0"
    first = "SELECT key, i, j FROM g" if decompose else "SELECT key, min(i) AS i, j FROM g JOIN r USING (key, i) GROUP BY key, j"
    conn = (lambda a, b: f"(({a} * 37 + {b} * 53) % 211 - 60)") if connected else (lambda a, b: "0")
    edges = "SELECT key, i, j, 0 AS l, 0 AS r, min(c) AS c FROM a0 GROUP BY key, i, j" if unique else "SELECT * FROM a0"
    table, id, text, _ = TEXTS[texts]
    text = '"東京スカイツリー" || reading' if texts == "joined" else text
    return f"""WITH RECURSIVE y AS (SELECT {id} AS id, dict_name, {text} AS t FROM {table}),
x AS (SELECT id, dict_name, t FROM y JOIN dictionaries USING (dict_name)),
s AS (SELECT id * 1000 + part AS key, *, length(s) AS n FROM (SELECT id, dict_name, unnest(l) AS s, generate_subscripts(l, 1) AS part FROM (SELECT *, regexp_extract_all(t, '[^\\n\\t。、]*[\\n\\t。、]|[^\\n\\t。、]+') AS l FROM x WHERE t IS NOT NULL))),
w AS (SELECT dict_name, CASE WHEN normalize_details THEN translate(surface, '―～', '—〜') ELSE surface END AS surface, left_context_id AS l, right_context_id AS r, cost::INT AS c FROM lexicon JOIN dictionaries USING (dict_name) {user}),
m AS (SELECT DISTINCT dict_name, length(surface) AS k FROM w),
p AS (SELECT key, dict_name, s, n, unnest(range(1, n + 1)) AS i FROM s),
e0 AS (SELECT p.key, p.i, p.i + k AS j, l, r, c FROM p JOIN m ON m.dict_name = p.dict_name AND p.i + k <= n + 1 JOIN w ON w.dict_name = p.dict_name AND w.surface = substr(s, p.i, k)),
u AS (SELECT key, i, i + length(regexp_extract(substr(s, i), '^(?:{runs})')) AS j, regexp_matches(substr(s, i, 1), '[{invoked}]') AS invoked FROM p),
g AS (SELECT key, i, j FROM u WHERE invoked OR (key, i) NOT IN (SELECT (key, i) FROM e0)),
o AS (SELECT key, i, j FROM e0 UNION SELECT key, i, j FROM g),
r AS (SELECT key, 1::BIGINT AS i FROM s UNION SELECT r.key, o.j FROM r JOIN o USING (key, i)),
f AS ({first}),
a0 AS (SELECT key, i, j, l, r, c FROM e0 UNION ALL SELECT key, i, j, 0, 0, {UNKNOWN_COST} FROM f),
a AS ({edges}),
e AS (SELECT a.*, s, n FROM a JOIN s USING (key)),
d AS (SELECT 1::BIGINT AS step, key, 1::BIGINT AS pos, 0 AS r, 0::BIGINT AS c FROM s UNION ALL
 SELECT step + 1, key, pos, r, unnest(min(c, {n})) FROM (SELECT step, key, pos, r, c FROM d WHERE pos > step UNION ALL SELECT d.step, d.key, e.j, e.r, d.c + e.c + {conn('d.r', 'e.l')} + {penalty} FROM d JOIN e ON d.key = e.key AND d.pos = e.i WHERE d.pos = d.step) GROUP BY step, key, pos, r),
z AS (SELECT id, key, d.c + {conn('d.r', '0')} AS c, row_number() OVER (PARTITION BY key ORDER BY d.c + {conn('d.r', '0')}) AS rank, min(d.c + {conn('d.r', '0')}) OVER (PARTITION BY key) AS best, strlen(s) AS b FROM d JOIN s USING (key) WHERE pos = step AND pos = n + 1)
{result}"""


_BEST = "SELECT id, sum(c)::BIGINT AS cost, sum(b)::BIGINT AS bytes FROM z WHERE rank = 1 GROUP BY id"
_RANKS = "SELECT id, rank::INT AS rank, sum(c)::BIGINT AS cost FROM z WHERE rank <= 3 {} GROUP BY id, rank"
ORACLES = {
    "segmented": _sql("triples", _BEST),
    "segmented_user": _sql("joined", _BEST, users=True),
    "segmented_decomposed": _sql("triples", _BEST, decompose=True),
    "nbest_costs": _sql("pairs", _RANKS.format(""), n=3),
    "nbest_threshold": _sql("pairs", _RANKS.format(f"AND c <= best + {THRESHOLD}"), n=3),
    "nbest_unique": _sql("pairs", _RANKS.format(""), n=3, connected=False, unique=True),
}
