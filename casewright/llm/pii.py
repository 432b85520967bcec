"""Personal data, and the terms that give it away.

Patterns find e-mail and IP addresses, card and phone numbers. The corpus then tells which
words reveal a protected value: a word discloses a value when their pointwise mutual
information reaches a share of the value's information content, which at 1 means that whoever
reads the word knows the value. Disclosing words are generalised, or removed where they
determine the value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import WORD, narrowed, stored, text_or_empty

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: The patterns of the four kinds. Repetitions give nothing back and a match begins where a run
#: of its first characters begins or the match before ended: equal to the plain forms, but linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IP = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
#: Characters trimmed from a word's ends.
EDGES = ".,;:!?\"'()[]{}#*$%&|<>"
#: A term has a letter somewhere; numbers are left to the patterns.
TERM_SHAPE = r"\p{L}"
#: Stands for a value where the words of the rest of its text are read.
MASK = "\x00"
#: Share of a value's information content from which a term discloses it, and from which it goes.
DISCLOSES, REMOVED = 0.9, 0.999
#: Different texts in which a term must stand beside a value; copies of one text prove nothing.
SUPPORT = 3
#: Terms up to which their table is sent to every task; beyond, words are shuffled.
BROADCAST_TERMS = 100_000


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    count = F.length(digits)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(_IP)
    if kind == "card":
        return F.when(count.between(12, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
    return count.between(9, 15)


def _value(kind: str, match: Column) -> Column:
    """What is protected, however it is written."""
    text = F.lower(match) if kind in ("email", "ip") else F.regexp_replace(match, "[^0-9]", "")
    return F.xxhash64(F.lit(kind), text)


def _word(token: Column) -> Column:
    return F.btrim(F.lower(token), F.lit(EDGES))


def _spans(kind: str, pieces: Column, matches: Column) -> Column:
    """(start, rank, end, value) of the valid matches; ``pieces`` are the texts between them."""
    span = "array<struct<start:int,rank:int,end:int,value:bigint>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans"))

    def step(state: Column, i: Column) -> Column:
        piece, match = F.get(pieces, i), F.get(matches, i)
        start = state["at"] + F.length(piece)
        end = start + F.length(match)
        one = F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), _value(kind, match).alias("value"),
        )
        spans = F.when(_valid(kind, match), F.concat(state["spans"], F.array(one))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    found = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), empty, step, lambda s: s["spans"])
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast(span))


def base_spans(df: DataFrame) -> DataFrame:
    """doc_id, content (a hash of the text) and ``spans`` of the four kinds, by start and kind, of every row.

    ``words`` are the distinct words with a letter of a text with spans, but for those that a span touches.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    for kind in KINDS:
        rows = rows.withColumn(f"_{kind}", F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0)))
    for kind in KINDS:
        pieces = F.when(F.size(f"_{kind}") > 0, F.split("text", PATTERNS[kind], -1)).otherwise(F.array().cast("array<string>"))
        rows = rows.withColumn(f"_{kind}_pieces", pieces)
    found = F.concat(*[_spans(kind, F.col(f"_{kind}_pieces"), F.col(f"_{kind}")) for kind in KINDS])
    rows = rows.select("doc_id", "text", F.array_sort(found).alias("spans"))
    rest = F.split(_replaced(F.col("text"), F.col("spans"), lambda s: F.lit(MASK)), r"[\x20\x09-\x0D]+")
    words = F.array_distinct(F.transform(F.filter(rest, lambda t: ~F.contains(t, F.lit(MASK))), _word))
    words = F.when(F.size("spans") > 0, F.filter(words, lambda w: w.rlike(TERM_SHAPE))).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", F.xxhash64("text").alias("content"), "spans", words.alias("words"))


def _corpus_words(df: DataFrame) -> DataFrame:
    """doc_id, content and each distinct word of a text once."""
    text = text_or_empty()
    words = F.array_distinct(F.transform(F.split(text, r"[\x20\x09-\x0D]+"), _word))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("content"), F.explode(words).alias("word"))


def _only(words: DataFrame, terms: DataFrame) -> DataFrame:
    return words.join(F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms, "word", "left_semi")


def disclosing_terms(df: DataFrame, base: DataFrame) -> DataFrame:
    """(word, disclosure): the terms that reveal a protected value and how far, at most 1.

    With documents as events, PMI = log2(N * n(value, word) / (n(value) * n(word))) and the
    value's information content is log2(N / n(value)); the disclosure is their quotient. A value
    in all documents holds no information, so nothing discloses it.

    A word stands beside a value when it is anywhere in a text with the value and no part of a value itself.
    Before pairs are made, values in fewer than ``SUPPORT`` different texts go, and so do words that by their
    number beside values alone stay below the threshold: a value is with a word in its own documents at most.
    """
    rows = base.count()
    marked = base.filter(F.size("spans") > 0).select("doc_id", "content", F.array_distinct(F.transform("spans", lambda s: s["value"])).alias("values"), "words")
    held = marked.select("content", F.explode("values").alias("value")).groupBy("value", "content").agg(F.count("*").alias("n"))
    values = held.groupBy("value").agg(F.sum("n").alias("n_value"), F.count("*").alias("texts"))
    values = stored(values.filter((F.col("texts") >= SUPPORT) & (F.col("n_value") < rows)).select("value", "n_value"))
    holding = held.join(values, "value").select("content").distinct()
    marked = marked.join(holding, "content", "left_semi")
    near = marked.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n_near")).filter(F.col("n_near") >= SUPPORT)

    def disclosure(n_word: Column) -> Column:
        return F.log2(rows * F.col("joint") / (F.col("n_value") * n_word)) / F.log2(rows / F.col("n_value"))

    # rounding must not decide here: what is just below is counted as well
    least = DISCLOSES - 1e-9
    most = values.select(F.max(F.pow("n_value", F.lit(least)) * F.pow(F.lit(float(rows)), F.lit(1 - least))).alias("most")).first()["most"]
    near = stored(near.filter(F.col("n_near") <= (most or 0.0) * (1 + 1e-9)))
    each = marked.groupBy("content", "values", "words").agg(F.count("*").alias("n"))
    holders = each.select("content", "n", F.explode("values").alias("value")).join(values, "value")
    tokens = each.select("content", F.explode("words").alias("word")).join(near, "word")
    beside = holders.join(tokens, "content").withColumn("joint", F.col("n_value")).filter(disclosure(F.col("n_near")) >= least)
    joint = beside.groupBy("value", "word", "n_value", "n_near").agg(F.sum("n").alias("joint"), F.count("*").alias("texts"))
    able = stored(joint.filter((F.col("texts") >= SUPPORT) & (disclosure(F.col("n_near")) >= least)))
    words = _only(_corpus_words(df), able.select("word").distinct()).groupBy("word").agg(F.count("*").alias("n_word"))
    ratio = disclosure(F.col("n_word"))
    known = able.join(words, "word")
    scored = known.select("word", F.least(ratio, F.lit(1.0)).alias("disclosure")).filter(F.col("disclosure") >= DISCLOSES)
    return stored(scored.groupBy("word").agg(F.max("disclosure").alias("disclosure")))


def _term_spans(df: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, content and ``terms``: (start, rank, end, value, words) of disclosing terms, of texts that hold any."""
    holding = _only(_corpus_words(df), terms.select("word")).join(terms, "word").groupBy("doc_id", "content").agg(
        F.sort_array(F.collect_set(F.struct("word", "disclosure"))).alias("held")  # at most the text's own words
    )
    holding = stored(holding)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("content", F.xxhash64("text"))
    rows = narrowed(rows, holding, "content")
    holding = holding.withColumnsRenamed({"doc_id": "_id", "content": "_content"})
    rows = rows.join(holding, rows["doc_id"].eqNullSafe(holding["_id"]) & (rows["content"] == holding["_content"]))
    rows = rows.select("doc_id", "content", F.split("text", WORD, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("tokens"), "held")
    span = "array<struct<start:int,rank:int,end:int,disclosure:double>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans"))

    def step(state: Column, i: Column) -> Column:
        token = F.get("tokens", i)
        start = state["at"] + F.length(F.get("gaps", i))
        bare = F.ltrim(token, F.lit(EDGES))
        begin = start + F.length(token) - F.length(bare)
        hit = F.filter("held", lambda h: h["word"] == _word(token))
        one = F.struct(
            begin.alias("start"), F.lit(len(KINDS)).alias("rank"), (begin + F.length(F.rtrim(bare, F.lit(EDGES)))).alias("end"),
            F.get(hit, F.lit(0))["disclosure"].alias("disclosure"),
        )
        spans = F.when(F.size(hit) > 0, F.concat(state["spans"], F.array(one))).otherwise(state["spans"])
        return F.struct((start + F.length(token)).alias("at"), spans.alias("spans"))

    found = F.aggregate(F.sequence(F.lit(0), F.size("tokens") - 1), empty, step, lambda s: s["spans"])
    return rows.select("doc_id", "content", found.alias("terms")).dropDuplicates(["doc_id", "content"])


def find(df: DataFrame) -> DataFrame:
    """doc_id, content and ``spans`` of every row, by start and kind: (start, rank, end, disclosure).

    ``rank`` counts through ``KINDS`` and then terms; ``disclosure`` is null for the four kinds.
    Offsets are code points, ends exclusive. Null and empty texts have no span; rows with equal id
    and text have equal spans; an empty table gives an empty result; other columns are not read.
    """
    base = stored(base_spans(df))
    terms = disclosing_terms(df, base)
    narrow = "array<struct<start:int,rank:int,end:int,disclosure:double>>"
    own = F.transform(
        "spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.lit(None).cast("double").alias("disclosure"))
    )
    base = base.select("doc_id", "content", own.alias("spans"))
    if terms.isEmpty():
        return base
    more = stored(_term_spans(df, terms)).withColumnsRenamed({"doc_id": "_id", "content": "_content"})
    joined = base.join(more, base["doc_id"].eqNullSafe(more["_id"]) & (base["content"] == more["_content"]), "left")
    every = F.array_sort(F.concat("spans", F.coalesce("terms", F.array().cast(narrow))))
    return joined.select("doc_id", "content", every.alias("spans"))


def spelled(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """The text with every span replaced.

    Of overlapping spans the first counts, and what the later one covers beyond it goes as well.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        out = F.concat(state["out"], gap, F.when(s["start"] >= state["at"], by(s)).otherwise(F.lit("")))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, start, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with every span replaced: values by their kind, terms by ``[WORD]`` or nothing."""
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    return _replaced(
        text, spans,
        lambda s: F.when(s["rank"] < len(KINDS), F.get(tags, s["rank"])).when(s["disclosure"] >= REMOVED, F.lit("")).otherwise(F.lit("[WORD]")),
    )


def sanitise(df: DataFrame) -> DataFrame:
    """``df`` with its text sanitised; a null text stays null. All its columns are kept.

    Rows are joined with their spans by id and a hash of the text.
    """
    spans = find(df).dropDuplicates(["doc_id", "content"]).select(
        F.col("doc_id").alias("_id"), F.col("content").alias("_content"), F.col("spans").alias("_spans")
    )
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text_or_empty()) == F.col("_content"))
    joined = df.join(spans, same, "left")
    return joined.withColumn("text", sanitised(F.col("text"), F.col("_spans"))).select(*df.columns)
