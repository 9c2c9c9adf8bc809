"""Queries of the analysis operators over the driver's tables, and the SQL that checks them."""

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kugiri.functions import formats
from kugiri.functions.tokenfilters import token_filter
from kugiri.model import Schema
from kugiri.operators import entries
from kugiri.plans import paths
from kugiri.operators.packed import known_values, split_column
from kugiri.plans.analyzer import Segmenter, Tokenizer, TokenizerBuilder, surface_counts
from kugiri.plans.shared import read, spread, stable
from kugiri.plans.skew import join_table
from kugiri.sources.bundled import _SCRIPTS, bundled, char_def
from kugiri.sources.definitions import Categories
from kugiri.sources.dictionary import context_frequencies, from_tables, group_entries
from kugiri.streaming.tokens import windowed_counts
from kugiri.trainer.crf import CrfTrainer
from kugiri.trainer.lexicon import CLASSES, Extractor, LexiconTrainer, Rewriter, TrainingConfig, to_cost

STOP = ["the", "of", "and", "a", "one", "each", "said", "die", "eine", "jede", "de", "le", "un", "el"]
TAGS = ["NUMERIC", "KATAKANA", "HANGUL"]
MAPPING = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "軸受": "ベアリング", "軸": "シャフト"}
#: Tags of words of the lexicon table.
JAPANESE_TAGS, KOREAN_TAGS = ["助詞,格助詞", "助詞,格助詞,地域", "助詞,格助詞,組織", "名詞,一般"], ["JKS", "NNG"]
#: Above every cost in the lexicon table, so that a word wins over the same text as an unknown word.
UNKNOWN_COST = 10_000
PATTERN = r"[0-9]+(?:\.[0-9]+)?"


def tokenizer(dictionary: str = "scripts", characters=(), tokens=(), **options) -> Tokenizer:
    builder = TokenizerBuilder().set_dictionary(f"embedded://{dictionary}")
    builder.config["segmenter"].update(options)
    for kind, args in characters:
        builder.append_character_filter(kind, args)
    for kind, args in tokens:
        builder.append_token_filter(kind, args)
    return builder.build()


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "documents").select("doc_id", "lang", "text"))


def _counted(characters=(), tokens=(), **options):
    """Counts of the surfaces that a chain makes of all documents."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        surfaces = tokenizer(characters=characters, tokens=tokens, **options).surfaces(spark, "text")
        return documents(spark, d).select(F.explode(surfaces).alias("surface")).groupBy("surface").agg(F.count("*").alias("n"))

    return query


def _by_lexicon(kind: str | None, tokens=(), keys=()):
    """As _counted, with the dictionaries of the lexicon table: those of one lang_group, or all; by dict_name and keys."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        chosen = read(spark, d, "dictionaries").where(F.lit(True) if kind is None else F.col("lang_group") == kind)
        dictionaries = from_tables(read(spark, d, "lexicon"), chosen, char_def(), UNKNOWN_COST)
        chains = {name: Tokenizer(Segmenter(dictionary), [], [token_filter(k, a) for k, a in tokens]) for name, dictionary in dictionaries.items()}
        return surface_counts(documents(spark, d).select(*keys, "text"), "text", chains, "dict_name")

    return query


def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: lower-case words without stop words, by language."""
    chain = tokenizer(tokens=[("lowercase", {}), ("stop_words", {"words": STOP})])
    rows = documents(spark, d).select("lang", F.explode(chain.surfaces(spark, "text")).alias("surface"))
    return rows.groupBy("lang", "surface").agg(F.count("*").alias("n"))


def token_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = tokenizer().tokenize_rows(documents(spark, d).select("doc_id", "text"), "text", details=False)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("byte_start").alias("starts"), F.sum("byte_end").alias("ends"), F.max("position").alias("last"), F.sum("position_length").alias("lengths"))


def token_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every token with its offsets and first detail, white space kept, of the evaluation passages."""
    items = read(spark, d, "eval_items").select("item_id", "text")
    rows = tokenizer(keep_whitespace=True).tokenize_rows(items, "text")
    return rows.select("item_id", "position", "surface", "byte_start", "byte_end", F.col("details")[0].alias("category"), "is_unknown")


def wakati(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", formats.wakati_column(tokenizer().tokens(spark, "text", details=False)).alias("line"))


def mecab(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "eval_items").select("item_id", "text")
    return items.select("item_id", formats.mecab_column(tokenizer().tokens(spark, "text")).alias("lines"))


def token_rows_documents(spark: SparkSession, d: str) -> DataFrame:
    """token_rows of all documents."""
    rows = tokenizer(keep_whitespace=True).tokenize_rows(documents(spark, d).select("doc_id", "text"), "text")
    return rows.select("doc_id", "position", "surface", "byte_start", "byte_end", F.col("details")[0].alias("category"), "is_unknown")


def mecab_documents(spark: SparkSession, d: str) -> DataFrame:
    """output_mecab of all documents."""
    rows = tokenizer().token_lists(documents(spark, d).select("doc_id", "text"), "text")
    return rows.select("doc_id", formats.mecab_column(F.col("tokens")).alias("lines"))


def _json_output(dictionary: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        chain = tokenizer(dictionary)
        rows = chain.token_lists(documents(spark, d).select("doc_id", "text"), "text")
        return rows.select("doc_id", formats.json_column(F.col("tokens"), chain.segmenter.dictionary.schema).alias("json"))

    return query


def sentence_rows(spark: SparkSession, d: str) -> DataFrame:
    return entries.sentence_rows(documents(spark, d).select("doc_id", "text"), "text").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("bytes").alias("longest"), F.sum("bytes").alias("bytes"))


def character_categories(spark: SparkSession, d: str) -> DataFrame:
    counts = documents(spark, d).select(F.explode(F.split("text", "")).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    return entries.with_categories(counts, "c", bundled("scripts").categories).select(F.explode_outer("categories").alias("category"), "n").groupBy("category").agg(F.sum("n").alias("n"))


def lexicon_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the dictionary that are prefixes of the distinct surfaces seen in it."""
    seen = read(spark, d, "token_views").select("dict_name", "surface").where("surface IS NOT NULL").distinct()
    return entries.prefix_matches(seen, read(spark, d, "lexicon").select("dict_name", "surface", "word_id"), ["dict_name"]).select("dict_name", "surface", "word_id", "end_char", "end_byte")


def lexicon_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the surfaces that are words of their dictionary, by how often they are seen."""
    seen = read(spark, d, "token_views").where("surface IS NOT NULL").groupBy("dict_name", "surface").agg(F.count("*").alias("seen"))
    return join_table(seen, read(spark, d, "lexicon"), ["dict_name", "surface"]).select("dict_name", "surface", "seen", "word_id", "left_context_id", "right_context_id", F.col("cost").cast("int").alias("cost"))


def word_details(spark: SparkSession, d: str) -> DataFrame:
    """Details of every token by its word id: unknown words have UNK, a missing system word has none; padded with *."""
    views = read(spark, d, "token_views").select("row_id", "dict_name", "word_id", "lex_type")
    dictionaries = read(spark, d, "dictionaries").select("dict_name", (F.col("n_fields") - 4).alias("width"))
    return entries.details_by_id(views, read(spark, d, "lexicon"), dictionaries).select("row_id", F.array_join("details", "|").alias("details"))


def grouped_entries(spark: SparkSession, d: str) -> DataFrame:
    words = read(spark, d, "lexicon").select("surface", "word_id", F.col("left_context_id").alias("left_id"), F.col("right_context_id").alias("right_id"), F.col("cost").cast("int").alias("cost"))
    return group_entries(words).select("surface", F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["word_id"].cast("string"), e["left_id"].cast("string"), e["right_id"].cast("string"), e["cost"].cast("string"))), " ").alias("entries"))


def context_ids(spark: SparkSession, d: str) -> DataFrame:
    return context_frequencies(read(spark, d, "lexicon").select(F.col("left_context_id").alias("left_id")))


def user_entries(spark: SparkSession, d: str) -> DataFrame:
    """Simple user words in their dictionary's schema."""
    users = read(spark, d, "user_words").select("entry_id", "dict_name", F.col("東京スカイツリー").alias("surface"), "part_of_speech", "reading")
    return entries.simple_user_words(users, read(spark, d, "dictionaries")).select("entry_id", "surface", "left_id", "right_id", "cost", F.array_join("details", "|").alias("details"))


def normalized_details(spark: SparkSession, d: str) -> DataFrame:
    normal = lambda c: F.translate(c, "―～", "—〜")
    return read(spark, d, "lexicon").select("word_id", normal(F.col("surface")).alias("surface"), F.array_join(F.transform("details", normal), "|").alias("details"))


def yearly_counts(spark: SparkSession, d: str) -> DataFrame:
    """Surfaces by year-long windows of filing, as on a stream."""
    docs = spread(read(spark, d, "documents").select("filed_at", "text"))
    return windowed_counts(docs, tokenizer(), "text", "filed_at", "360 days").select(F.unix_timestamp("window.start").alias("start"), "surface", "n")


def nbest(spark: SparkSession, d: str) -> DataFrame:
    """Three cheapest analyses of each document."""
    return tokenizer("function-words").nbest_rows(documents(spark, d).select("doc_id", "text"), "text", 3, joined=" ")


def decomposed(spark: SparkSession, d: str) -> DataFrame:
    """Tags and surfaces in decompose mode; details meet the counts, not the tokens."""
    chain = tokenizer("function-words", mode="decompose")
    rows = chain.tokenize_rows(documents(spark, d).select("text"), "text", details=False)
    counts = rows.groupBy("lex_type", "word_id", "surface").agg(F.count("*").alias("n"))
    return join_table(counts, chain.segmenter.dictionary.details_table(spark), ["lex_type", "word_id"]).groupBy(F.col("details")[0].alias("tag"), "surface").agg(F.sum("n").alias("n"))


CHARACTERS = "DEFAULT 0 1 0\nHIRAGANA 1 1 0\nKATAKANA 1 1 0\nKANJI 0 0 2\nALPHA 1 1 0\nNUMERIC 1 1 0\n0x3041..0x3096 HIRAGANA\n0x30A1..0x30F6 KATAKANA\n0x4E00..0x9FAF KANJI\n0x0030..0x0039 NUMERIC\n0x0041..0x005A ALPHA\n0x0061..0x007A ALPHA\n"


def annotated_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of the training corpus: dict_name, sentence_id and tokens (surface, feature) in the order of the words.

    Rows repeated under another row_id count once; packed features are split into their values and joined by commas.
    """
    words = read(spark, d, "corpus_words").select("dict_name", "sentence_id", "word_pos", "row_id", "surface", "feature")
    known = known_values(read(spark, d, "lexicon"))
    values = F.coalesce(F.array_join(split_column(F.col("feature"), known), ","), F.lit(""))
    words = spread(words).withColumn("feature", values).repartition(spark.sparkContext.defaultParallelism, "dict_name", "sentence_id")
    once = words.groupBy("dict_name", "sentence_id", "word_pos").agg(F.min_by(F.struct("surface", "feature"), "row_id").alias("word"))
    rows = once.groupBy("dict_name", "sentence_id").agg(F.sort_array(F.collect_list(F.struct("word_pos", "word"))).alias("words"))
    return rows.select("dict_name", "sentence_id", F.transform("words", lambda w: w["word"]).alias("tokens"))


def trained_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Costs of every dictionary's words, each dictionary trained on all annotated sentences of its own."""
    words: dict[str, list] = {}
    for r in read(spark, d, "lexicon").orderBy("word_id").select("dict_name", "surface", "details").collect():
        words.setdefault(r.dict_name, []).append((r.surface, ",".join(r.details)))
    sentences = stable(annotated_sentences(spark, d))

    def train(name: str) -> list[tuple]:
        unknown = ",".join(["UNK", *["*"] * words[name][0][1].count(",")])
        config = TrainingConfig(words[name], Categories(CHARACTERS), dict.fromkeys(CLASSES, unknown), Extractor("UNIGRAM U:%F[0]\nUNIGRAM W:%w\nBIGRAM B:%L[0]/%R[0]\n"), Rewriter())
        own = spread(sentences.where(F.col("dict_name") == name))
        model = LexiconTrainer(config, CrfTrainer("l2", 0.1)).train(own)
        return [(name, s, left, right, to_cost(w, model.cost_factor)) for s, (w, left, right) in zip(model.surfaces, model.words)]

    # the small steps of one training leave cores free for the others
    with ThreadPoolExecutor(max(1, len(words))) as pool:
        rows = [r for own in pool.map(train, words) for r in own]
    return spark.createDataFrame(rows, "dict_name string, surface string, left_id int, right_id int, cost int")


def _by_field(kind: str, group: str):
    """Surfaces that a filter by field makes of all token rows of one language group, whose details are looked up by word id."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        chosen = read(spark, d, "dictionaries").where(F.col("lang_group") == group)
        views = read(spark, d, "token_views").drop("details").where("surface IS NOT NULL")
        tokens = entries.details_by_id(views, read(spark, d, "lexicon"), chosen.select("dict_name", (F.col("n_fields") - 4).alias("width")))
        fields = ("surface", "byte_start", "byte_end", "position", "position_length", "word_id", "lex_type", "is_unknown", "details")
        parts = []
        for r in chosen.select("dict_name", "dictionary_schema").collect():
            made = token_filter(kind, {}).column_for(Schema(tuple(r.dictionary_schema)))
            own = tokens.where(F.col("dict_name") == r.dict_name)
            parts.append(own.select("dict_name", made(F.array(F.struct(*fields)))[0]["surface"].alias("surface")))
        return reduce(DataFrame.unionAll, parts).groupBy("dict_name", "surface").agg(F.count("*").alias("n"))

    return query


def _text_filter(kind: str, args: dict):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return documents(spark, d).select("doc_id", entries.filter_column(kind, args)(F.col("text")).alias("text"))

    return query


QUERIES = {
    "tokenize_counts": tokenize_counts,
    "token_offsets": token_offsets,
    "token_rows": token_rows,
    "token_rows_documents": token_rows_documents,
    "surfaces": _counted(),
    "surfaces_with_whitespace": _counted(keep_whitespace=True),
    "output_wakati": wakati,
    "output_mecab": mecab,
    "output_mecab_documents": mecab_documents,
    "output_json": _json_output("function-words"),
    "output_json_runs": _json_output("scripts"),
    "sentences": sentence_rows,
    "character_categories": character_categories,
    "filter_unicode_nfc": _text_filter("unicode_normalize", {"kind": "nfc"}),
    "filter_unicode_nfkc": _text_filter("unicode_normalize", {"kind": "nfkc"}),
    "filter_regex": _text_filter("regex", {"pattern": PATTERN, "replacement": "#$1"}),
    "filter_mapping": _text_filter("mapping", {"mapping": MAPPING}),
    "filter_iteration_mark": _text_filter("japanese_iteration_mark", {"normalize_kanji": True, "normalize_kana": True}),
    "tokens_lowercase": _counted(tokens=[("lowercase", {})]),
    "tokens_uppercase": _counted(tokens=[("uppercase", {})]),
    "tokens_length": _counted(tokens=[("length", {"min": 3, "max": 8})]),
    "tokens_keep_words": _counted(tokens=[("keep_words", {"words": STOP})]),
    "tokens_stop_words": _counted(tokens=[("stop_words", {"words": STOP})]),
    "tokens_japanese_keep_tags": _counted(tokens=[("japanese_keep_tags", {"tags": TAGS})]),
    "tokens_japanese_stop_tags": _counted(tokens=[("japanese_stop_tags", {"tags": TAGS})]),
    "tokens_korean_keep_tags": _counted(tokens=[("korean_keep_tags", {"tags": TAGS})]),
    "tokens_korean_stop_tags": _counted(tokens=[("korean_stop_tags", {"tags": TAGS})]),
    "tokens_katakana_stem": _counted(tokens=[("japanese_katakana_stem", {"min": 3})]),
    "tokens_kana": _counted(tokens=[("japanese_kana", {"kind": "katakana"})]),
    "tokens_mapping": _counted(tokens=[("mapping", {"mapping": MAPPING})]),
    "tokens_remove_diacritical_mark": _counted(tokens=[("remove_diacritical_mark", {})]),
    "tokens_base_form": _by_field("japanese_base_form", "ja"),
    "tokens_reading_form": _by_field("japanese_reading_form", "ja"),
    "tokens_korean_reading_form": _by_field("korean_reading_form", "ko"),
    "tokens_number": _counted(tokens=[("japanese_number", {})]),
    "tokens_compound_word": _counted(tokens=[("japanese_compound_word", {"tags": ["KATAKANA", "KANJI"], "new_tag": "COMPOUND"})]),
    "tokenize_counts_lexicon": _by_lexicon(None, [("lowercase", {}), ("stop_words", {"words": STOP})], ["lang"]),
    "tokens_base_form_lexicon": _by_lexicon("ja", [("japanese_base_form", {})]),
    "tokens_reading_form_lexicon": _by_lexicon("ja", [("japanese_reading_form", {})]),
    "tokens_korean_reading_form_lexicon": _by_lexicon("ko", [("korean_reading_form", {})]),
    "tokens_japanese_keep_tags_lexicon": _by_lexicon("ja", [("japanese_keep_tags", {"tags": JAPANESE_TAGS})]),
    "tokens_japanese_stop_tags_lexicon": _by_lexicon("ja", [("japanese_stop_tags", {"tags": JAPANESE_TAGS})]),
    "tokens_korean_keep_tags_lexicon": _by_lexicon("ko", [("korean_keep_tags", {"tags": KOREAN_TAGS})]),
    "tokens_korean_stop_tags_lexicon": _by_lexicon("ko", [("korean_stop_tags", {"tags": KOREAN_TAGS})]),
    "lexicon_prefixes": lexicon_prefixes,
    "lexicon_lookup": lexicon_lookup,
    "word_details": word_details,
    "grouped_entries": grouped_entries,
    "context_ids": context_ids,
    "user_entries": user_entries,
    "normalized_details": normalized_details,
    "yearly_counts": yearly_counts,
    "nbest": nbest,
    "decomposed": decomposed,
    "trained_lexicon": trained_lexicon,
    **paths.QUERIES,
}


# SQL ------------------------------------------------------------------------------------------------------------


def _class(name: str) -> str:
    return "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in _SCRIPTS[name][1])


_NAMED = [n for n in _SCRIPTS if n != "DEFAULT"]
_ALL = "".join(map(_class, _NAMED))
#: Longest runs of one category; a sentence ends behind 、 and 。.
_BLANK = _class("SPACE")
#: Also behind line ends and tabs.
_INLINE = "\\x{b}-\\x{d}" + _BLANK.removeprefix("\\x{9}-\\x{d}")
_RUNS = "|".join([f"[{_class(n)}]+" for n in _NAMED if n != "SPACE"] + [f"[^{_ALL}、。]*[、。]|[^{_ALL}、。]+|[{_INLINE}]*[\\n\\t]|[{_INLINE}]+"])
_TAG = "CASE " + " ".join(f"WHEN regexp_full_match(s, '[{_class(n)}]+') THEN '{n}'" for n in _NAMED) + " ELSE 'DEFAULT' END"
_TOKENS = f"t AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '{_RUNS}')) AS s FROM documents WHERE text IS NOT NULL), k AS (SELECT * FROM t WHERE NOT regexp_full_match(s, '[{_class('SPACE')}]+'))"
_WORDS = ", ".join(f"'{w}'" for w in STOP)
_IN_TAGS = "tag IN (" + ", ".join(f"'{t}'" for t in TAGS) + ")"


def _count_sql(surface: str = "s", where: str = "true", source: str = "k") -> str:
    return f"WITH {_TOKENS}, g AS (SELECT *, {_TAG} AS tag FROM {source}) SELECT {surface} AS surface, count(*) AS n FROM g WHERE {where} GROUP BY 1"


def _numbered(table: str, id: str) -> str:
    return f"a AS (SELECT {id}, regexp_extract_all(text, '{_RUNS}') AS l FROM {table} WHERE text IS NOT NULL), u AS (SELECT {id}, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM a), o AS (SELECT *, sum(strlen(s)) OVER (PARTITION BY {id} ORDER BY i) AS e, NOT regexp_full_match(s, '[{_class('SPACE')}]+') AS kept FROM u)"


def _field_sql(field: str, group: str) -> str:
    value = f"l.details[list_position(dictionary_schema, '{field}') - 4]"
    return f"SELECT v.dict_name, CASE WHEN NOT is_unknown AND lex_type = 'System' AND {value} <> '*' THEN {value} ELSE v.surface END AS surface, count(*) AS n FROM token_views v JOIN dictionaries d ON d.dict_name = v.dict_name AND lang_group = '{group}' LEFT JOIN lexicon l USING (word_id) WHERE v.surface IS NOT NULL GROUP BY ALL"


_MAPPED = "replace(replace(replace(replace(replace(replace({}, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '軸受', 'ベアリング'), '軸', 'シャフト')"
_HIRAGANA, _KATAKANA = "".join(map(chr, range(0x3041, 0x3097))), "".join(map(chr, range(0x30A1, 0x30F7)))
_FIELDS = "part_of_speech part_of_speech_subcategory_1 part_of_speech_subcategory_2 part_of_speech_subcategory_3 conjugation_form conjugation_type base_form reading pronunciation".split()
_JSON = "'{\"surface\":' || to_json(s) || ',\"byte_start\":' || (e - strlen(s)) || ',\"byte_end\":' || e || ',\"word_id\":' || (list_position([" + ", ".join(f"'{n}'" for n in _SCRIPTS) + f"], {_TAG}) - 1) || ',\"{_FIELDS[0]}\":\"' || {_TAG} || '\"' || '" + "".join(f',\"{n}\":\"*\"' for n in _FIELDS[1:]) + "}'"
_SAME_UPPER = "replace(upper({}), 'ẞ', 'SS')"

ORACLES = {
    **paths.ORACLES,
    "tokenize_counts": f"WITH {_TOKENS} SELECT lang, lower(s) AS surface, count(*) AS n FROM k WHERE lower(s) NOT IN ({_WORDS}) GROUP BY ALL",
    "token_offsets": f"WITH {_numbered('documents', 'doc_id')} SELECT doc_id, count(*) AS n, sum(e - strlen(s))::BIGINT AS starts, sum(e)::BIGINT AS ends, (count(*) - 1)::INT AS last, count(*) AS lengths FROM o WHERE kept GROUP BY doc_id",
    "token_rows": f"WITH {_numbered('eval_items', 'item_id')} SELECT item_id, (i - 1)::INT AS position, s AS surface, (e - strlen(s))::INT AS byte_start, e::INT AS byte_end, {_TAG} AS category, true AS is_unknown FROM o",
    "surfaces": _count_sql(),
    "surfaces_with_whitespace": _count_sql(source="t"),
    "output_wakati": f"WITH {_numbered('documents', 'doc_id')} SELECT doc_id, coalesce(string_agg(s, ' ' ORDER BY i) FILTER (kept) || chr(10), '') AS line FROM (SELECT * FROM o UNION ALL SELECT doc_id, NULL, NULL, NULL, false FROM documents WHERE text IS NOT NULL) GROUP BY doc_id UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL",
    "output_mecab": f"WITH {_numbered('eval_items', 'item_id')} SELECT item_id, coalesce(string_agg(s || chr(9) || {_TAG} || ',*,*,*,*,*,*,*,*' || chr(10), '' ORDER BY i) FILTER (kept), '') || 'EOS' || chr(10) AS lines FROM o GROUP BY item_id",
    "token_rows_documents": f"WITH {_numbered('documents', 'doc_id')} SELECT doc_id, (i - 1)::INT AS position, s AS surface, (e - strlen(s))::INT AS byte_start, e::INT AS byte_end, {_TAG} AS category, true AS is_unknown FROM o",
    "output_mecab_documents": f"WITH {_numbered('documents', 'doc_id')} SELECT doc_id, coalesce(string_agg(s || chr(9) || {_TAG} || ',*,*,*,*,*,*,*,*' || chr(10), '' ORDER BY i) FILTER (kept), '') || 'EOS' || chr(10) AS lines FROM o GROUP BY doc_id UNION ALL SELECT doc_id, 'EOS' || chr(10) FROM documents WHERE text = '' UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL",
    "output_json_runs": f"WITH {_numbered('documents', 'doc_id')}, j AS (SELECT doc_id, '[' || coalesce(string_agg({_JSON}, ',' ORDER BY i) FILTER (kept), '') || ']' AS json FROM o GROUP BY doc_id) SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(json, '[]') END AS json FROM documents LEFT JOIN j USING (doc_id)",
    "sentences": "WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\n\\t。、]*[\\n\\t。、]|[^\\n\\t。、]+')) AS s FROM documents) SELECT doc_id, count(*) AS n, max(strlen(s)) AS longest, sum(strlen(s))::BIGINT AS bytes FROM s GROUP BY doc_id",
    "character_categories": f"WITH c AS (SELECT unnest(string_split(text, '')) AS s FROM documents), g AS (SELECT s, count(*) AS n FROM c WHERE s <> '' GROUP BY s) SELECT {_TAG} AS category, sum(n)::BIGINT AS n FROM g GROUP BY 1",
    "filter_unicode_nfc": "SELECT doc_id, nfc_normalize(text) AS text FROM documents",
    "filter_regex": f"SELECT doc_id, regexp_replace(text, '{PATTERN}', '#$1', 'g') AS text FROM documents",
    "filter_mapping": f"SELECT doc_id, {_MAPPED.format('text')} AS text FROM documents",
    "tokens_lowercase": _count_sql("lower(s)"),
    "tokens_uppercase": _count_sql(_SAME_UPPER.format("s")),
    "tokens_length": _count_sql(where="length(s) BETWEEN 3 AND 8"),
    "tokens_keep_words": _count_sql(where=f"s IN ({_WORDS})"),
    "tokens_stop_words": _count_sql(where=f"s NOT IN ({_WORDS})"),
    "tokens_japanese_keep_tags": _count_sql(where=_IN_TAGS),
    "tokens_japanese_stop_tags": _count_sql(where=f"NOT ({_IN_TAGS})"),
    "tokens_korean_keep_tags": _count_sql(where=_IN_TAGS),
    "tokens_korean_stop_tags": _count_sql(where=f"NOT ({_IN_TAGS})"),
    "tokens_katakana_stem": _count_sql("CASE WHEN regexp_full_match(s, '[゠-ヿ]*ー') AND length(s) > 3 THEN s[:-2] ELSE s END"),
    "tokens_kana": _count_sql(f"translate(s, '{_HIRAGANA}', '{_KATAKANA}')"),
    "tokens_mapping": _count_sql(_MAPPED.format("s")),
    "tokens_remove_diacritical_mark": _count_sql("CASE WHEN tag = 'ALPHA' THEN list_aggregate(list_transform(string_split(s, ''), lambda c: CASE WHEN ord(c) < 592 THEN strip_accents(c) ELSE c END), 'string_agg', '') ELSE s END"),
    "tokens_base_form": _field_sql("base_form", "ja"),
    "tokens_reading_form": _field_sql("reading", "ja"),
    "tokens_korean_reading_form": _field_sql("reading", "ko"),
    "tokens_compound_word": f"WITH {_numbered('documents', 'doc_id')}, g AS (SELECT doc_id, i, s, {_TAG} IN ('KATAKANA', 'KANJI') AS m FROM o WHERE kept), h AS (SELECT *, CASE WHEN m THEN row_number() OVER (PARTITION BY doc_id ORDER BY i) - row_number() OVER (PARTITION BY doc_id, m ORDER BY i) ELSE i END AS run FROM g), j AS (SELECT string_agg(s, '' ORDER BY i) AS surface FROM h GROUP BY doc_id, m, run) SELECT surface, count(*) AS n FROM j GROUP BY surface",
    "lexicon_prefixes": "WITH s AS (SELECT DISTINCT dict_name, surface FROM token_views WHERE surface IS NOT NULL) SELECT s.dict_name, s.surface, l.word_id, length(l.surface)::INT AS end_char, strlen(l.surface)::INT AS end_byte FROM s JOIN lexicon l ON s.dict_name = l.dict_name AND starts_with(s.surface, l.surface)",
    "lexicon_lookup": "WITH s AS (SELECT dict_name, surface, count(*) AS seen FROM token_views WHERE surface IS NOT NULL GROUP BY ALL) SELECT s.dict_name, s.surface, seen, word_id, left_context_id, right_context_id, cost::INT AS cost FROM s JOIN lexicon l USING (dict_name, surface)",
    "word_details": "SELECT row_id, array_to_string(list_resize(CASE WHEN lex_type = 'System' THEN coalesce(l.details, []) ELSE ['UNK'] END, greatest((n_fields - 4), len(CASE WHEN lex_type = 'System' THEN coalesce(l.details, []) ELSE ['UNK'] END)), '*'), '|') AS details FROM token_views v JOIN dictionaries USING (dict_name) LEFT JOIN lexicon l USING (word_id)",
    "grouped_entries": "SELECT surface, string_agg(word_id || ':' || left_context_id || ':' || right_context_id || ':' || cost, ' ' ORDER BY word_id) AS entries FROM lexicon GROUP BY surface",
    "context_ids": "WITH c AS (SELECT left_context_id AS left_id, count(*) AS n FROM lexicon GROUP BY 1) SELECT left_id, n, CASE WHEN left_id = 0 THEN 0 ELSE row_number() OVER (PARTITION BY left_id = 0 ORDER BY n DESC, left_id) END AS rank FROM c",
    "user_entries": "SELECT entry_id, \"東京スカイツリー\" AS surface, default_left_context_id AS left_id, default_right_context_id AS right_id, default_word_cost AS cost, array_to_string(list_transform(dictionary_schema[5:], lambda f: CASE f WHEN user_dictionary_schema[2] THEN coalesce(part_of_speech, default_field_value) WHEN user_dictionary_schema[3] THEN coalesce(reading, default_field_value) ELSE default_field_value END), '|') AS details FROM user_words JOIN dictionaries USING (dict_name) WHERE trim(\"東京スカイツリー\") <> ''",
    "normalized_details": "SELECT word_id, translate(surface, '―～', '—〜') AS surface, translate(array_to_string(details, '|'), '―～', '—〜') AS details FROM lexicon",
    "yearly_counts": f"WITH t AS (SELECT filed_at, unnest(regexp_extract_all(text, '{_RUNS}')) AS s FROM documents WHERE text IS NOT NULL AND filed_at IS NOT NULL) SELECT (epoch_us(filed_at) // 1000000 - ((epoch_us(filed_at) // 1000000) % 31104000 + 31104000) % 31104000)::BIGINT AS start, s AS surface, count(*) AS n FROM t WHERE NOT regexp_full_match(s, '[{_class('SPACE')}]+') GROUP BY ALL",
}
