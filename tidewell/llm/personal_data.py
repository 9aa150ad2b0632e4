"""Personal data in texts: fixed patterns, and bootstrapped contextual extraction.

The fixed patterns find e-mail and IP addresses, card numbers and phone numbers. What they
find are the seeds. A lexical pattern is two neighbouring words, or one together with the shape
of what stands beside it; patterns and the identifiers that occur in them form a graph. In rounds,
patterns are scored by the share of their identifiers that are trusted, and identifiers by
the patterns they occur in; identifiers that high-confidence patterns trust are personal
data too, though no fixed pattern knows them.

Only DataFrame functions are used. Each text is looked at once, however many rows have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import table, written

#: In this order where spans start at the same place.
KINDS = ("email", "ip", "card", "phone")

# Each has the same matches as the pattern in its comment, but takes linear time and no stack
# on any text: a match begins where a run of its characters does, or right after another match.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ where that has 12 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What may be an identifier: letters, digits and joining signs with a digit among the first 64.
TOKEN = r"(?<![\p{L}\p{N}])(?=[\p{L}._%+@:/-]{0,64}[0-9])[\p{L}\p{N}](?:[\p{L}\p{N}._%+@:/-]*[\p{L}\p{N}])?"
#: What `_matches` calls seeds and tokens alike, which may be identifiers.
CANDIDATE = "candidate"
#: Nothing of the above is in a text without one of these.
ANY = "[0-9@]"

#: Characters of text on either side in which neighbouring words are looked for.
CONTEXT = 64
#: Bytes of text that a task looks through, some seconds of work; beyond MOST_TASKS of them, tasks get more.
TASK_BYTES = 16 << 20
MOST_TASKS = 100_000
ROUNDS = 3
#: A pattern needs this score to discover, an identifier this one to be discovered.
PATTERN_SCORE = 0.6
IDENTIFIER_SCORE = 0.8

_KEY = ["_one", "_two"]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """Whether a match of the kind's pattern counts."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: part.cast("double") <= 255)
    if kind == "card":
        return F.length(_digits(match)).between(12, 19) & _luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_one"), F.xxhash64(F.length(text), F.reverse(text)).alias("_two")]


def _dealt(texts: DataFrame) -> DataFrame:
    """`texts` in as many partitions as their bytes ask for, by their keys."""
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    return texts.repartition(min(1 + size // TASK_BYTES, MOST_TASKS), *_KEY)


def _matches(texts: DataFrame) -> DataFrame:
    """kind, _start and _end of every match of every pattern in _text, with _match and the text around it.

    All patterns are looked for in one stage; what is found in a text stays in its partition.
    """
    looked_for = {**PATTERNS, CANDIDATE: "|".join([PATTERNS["email"], PATTERNS["phone"], PATTERNS["card"], PATTERNS["ip"], TOKEN])}
    each = [F.struct(F.lit(k).alias("kind"), F.lit(p).alias("pattern"), F.regexp_extract_all("_text", F.lit(p), F.lit(0)).alias("found")) for k, p in looked_for.items()]
    pieces = texts.select(*_KEY, "_text", F.inline(F.array(*each))).where(F.size("found") > 0)
    pieces = pieces.select(*_KEY, "kind", F.col("found").alias("_found"), F.split("_text", F.col("pattern"), -1).alias("_gaps"))
    each = pieces.select(*_KEY, "kind", F.posexplode(F.arrays_zip("_found", "_gaps")).alias("_i", "_x"))
    each = each.select(*_KEY, "kind", "_i", F.col("_x._found").alias("_match"), F.col("_x._gaps").alias("_gap"))
    # the text after the last match is a gap without a match
    order = Window.partitionBy(*_KEY, "kind").orderBy("_i")
    upto = F.sum(F.length("_gap") + F.coalesce(F.length("_match"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("_end", upto).withColumn("_after", F.substring(F.lead("_gap").over(order), 1, CONTEXT)).where("_match is not null")
    return each.select(*_KEY, "kind", (F.col("_end") - F.length("_match")).alias("_start"), "_end", "_match", F.substring("_gap", -CONTEXT, CONTEXT).alias("_before"), "_after")


def _base(matches: DataFrame) -> DataFrame:
    """The spans that the fixed patterns find."""
    counts = F.coalesce(*(F.when(F.col("kind") == k, valid(k, F.col("_match"))) for k in KINDS), F.lit(False))
    return matches.where(counts).select(*_KEY, "kind", F.col("_start").alias("start"), F.col("_end").alias("end"))


def _occurrences(matches: DataFrame) -> DataFrame:
    """Seeds and other possible identifiers, where they stand, and the patterns they stand in."""
    found = matches.where(F.col("kind") == CANDIDATE)
    seed = F.coalesce(*(F.when(F.col("_match").rlike(f"^(?:{PATTERNS[k]})$") & valid(k, F.col("_match")), F.lit(k)) for k in ("email", "phone", "card", "ip")))
    shape = F.regexp_replace(F.regexp_replace("_match", "[0-9]", "0"), r"\p{L}+", "a")
    before = F.split(F.lower(F.regexp_replace("_before", r"\s+$", "")), r"\s+")
    after = F.split(F.lower(F.regexp_replace("_after", r"^\s+", "")), r"\s+")
    near = F.concat_ws(" ", F.element_at(before, -1), F.lit("<"), shape), F.concat_ws(" ", shape, F.lit(">"), F.get(after, F.lit(0)))
    # two words say enough for any shape; fewer, at either end of a text, don't
    wide = (
        F.when(F.size(before) > 2, F.concat_ws(" ", F.element_at(before, -2), F.element_at(before, -1), F.lit("<"))),
        F.when(F.size(after) > 2, F.concat_ws(" ", F.lit(">"), F.get(after, F.lit(0)), F.get(after, F.lit(1)))),
    )
    patterns = F.array_compact(F.array(*near, *wide))
    return found.select(*_KEY, F.col("_start").alias("start"), F.col("_end").alias("end"), F.col("_match").alias("item"), seed.alias("seed"), patterns.alias("patterns"))


def scores(occurrences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, score) and (item, kind, score) after ROUNDS rounds over the graph."""
    edges = written(occurrences.select(F.explode("patterns").alias("pattern"), "item").distinct(), "pattern-edges")
    seeds = written(occurrences.where("seed is not null").select("item", F.col("seed").alias("kind")).distinct().withColumn("score", F.lit(1.0)), "seeds")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("items"))
    items = seeds
    for _ in range(ROUNDS):
        trusted = edges.join(items, "item").groupBy("pattern", "kind").agg(F.sum("score").alias("trust"))
        # one more item that isn't trusted stands for those not seen
        patterns = written(trusted.join(sizes, "pattern").select("pattern", "kind", (F.col("trust") / (F.col("items") + 1)).alias("score")), "pattern-scores")
        good = patterns.where(F.col("score") >= PATTERN_SCORE)
        new = edges.join(good, "pattern").groupBy("item", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("score"))
        items = written(new.join(seeds.select("item"), "item", "left_anti").union(seeds), "item-scores")
    return patterns, items


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """_one, _two (a text's key), kind, start, end and base for all texts of `docs`.

    Offsets are in code points, the end exclusive. Texts that are null or empty have no spans.
    """
    t = F.col(text)
    texts = docs.select(t.alias("_text"), *_text_key(t)).where(F.col("_text").rlike(ANY))
    texts = written(texts.groupBy(*_KEY).agg(F.any_value("_text").alias("_text")), "texts")
    matches = written(_matches(_dealt(texts)), "matches")
    base = _base(matches).withColumn("base", F.lit(True))
    found = written(_occurrences(matches), "identifiers")
    _, items = scores(found)
    trusted = items.where(F.col("score") >= IDENTIFIER_SCORE).select("item", "kind")
    more = found.where("seed is null").join(trusted, "item").select(*_KEY, "kind", "start", "end", F.lit(False).alias("base"))
    return base.union(more).groupBy(*_KEY, "kind", "start", "end").agg(F.max("base").alias("base"))


def _listed(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def found(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key, its numbers of spans by kind, and its spans: base ones hashed, all listed.

    Rows stay apart, equal ones too. A text that is null or empty has no spans, so its list is empty.
    """
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    by_text = spans(docs, text).groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("start", order.alias("order"), "end", "kind", "base"))).alias("_spans"))
    by_text = written(by_text, "text-spans")  # a table of its own, so that the join below may split the copies of one text
    own = docs.select(F.col(key).alias("_doc"), *_text_key(F.col(text)))
    all_ = F.coalesce("_spans", F.array().cast("array<struct<start:bigint,order:bigint,end:bigint,kind:string,base:boolean>>"))
    both = own.join(by_text, _KEY, "left").select("_doc", all_.alias("_spans"))
    base = F.filter("_spans", lambda s: s["base"])
    counts = [F.size(F.array_remove(F.transform(base, lambda s: s["kind"] == F.lit(k)), False)).cast("long").alias(f"n_{k}") for k in KINDS]
    return both.select(F.col("_doc").alias("doc_id"), *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("_spans")).alias("spans"))


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every span in `text` replaced by its kind in angle brackets.

    Spans that overlap are replaced as one, by the kind of the first. Texts without spans,
    null ones too, stay as they are, and so do all other columns and the number of rows.
    """
    order = Window.partitionBy(*_KEY).orderBy("start", "end", "kind")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans(docs, text).withColumn("_new", (F.coalesce(before, F.lit(0)) <= F.col("start")).cast("int")).withColumn("_island", F.sum("_new").over(order))
    islands = islands.groupBy(*_KEY, "_island").agg(F.min(F.struct("start", "end", "kind")).alias("_first"), F.max("end").alias("end"))
    cuts = islands.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct(F.col("_first.start").alias("start"), "end", F.col("_first.kind").alias("kind")))).alias("_cuts"))
    cuts = written(cuts, "text-cuts")  # as in `found`
    t = F.col("_row")[text]
    # the cuts grow with the input, so they are never broadcast: the plan is the same at every size
    own = docs.select(F.struct(*docs.columns).alias("_row"), *_text_key(F.col(text))).join(cuts.hint("merge"), _KEY, "left")

    def piece(cut: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get("_cuts", i - 1)["end"]).cast("int")
        return F.concat(F.substring(t, start + 1, cut["start"].cast("int") - start), F.lit("<"), cut["kind"], F.lit(">"))

    rest = F.substring(t, (F.element_at("_cuts", -1)["end"] + 1).cast("int"), F.length(t))
    new = F.when(F.col("_cuts").isNull(), t).otherwise(F.concat(F.array_join(F.transform("_cuts", piece), ""), rest))
    return own.select(*(new.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "documents"))


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `query` returns of the fixed patterns, which SQL can express."""
    return query(spark, sf_dir).drop("spans")


_COUNTS = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda p: p::DOUBLE <= 255))",
    "card": "length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: (substr(digits, -i, 1)::INT * (2 - i % 2)) // 10 + (substr(digits, -i, 1)::INT * (2 - i % 2)) % 10)) % 10 = 0",
    "phone": "length(digits) BETWEEN 9 AND 15",
}
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PARTS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {i} AS k, regexp_extract_all(text, '{p}') AS found, string_split_regex(text, '{p}') AS gaps FROM documents WHERE text IS NOT NULL" for i, (k, p) in enumerate(_PLAIN.items()))
BASE_ORACLE = f"""
WITH parts AS ({_PARTS}), pieces AS (
  SELECT doc_id, kind, k, unnest(found) AS m, unnest(gaps) AS gap, generate_subscripts(gaps, 1) AS i FROM parts WHERE len(found) > 0
), placed AS (
  SELECT doc_id, kind, k, m, regexp_replace(m, '[^0-9]', '', 'g') AS digits,
         sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop
  FROM pieces
), spans AS (
  SELECT doc_id, kind, k, (stop - length(m))::BIGINT AS start, stop::BIGINT AS stop FROM placed
  WHERE m IS NOT NULL AND CASE kind {" ".join(f"WHEN '{k}' THEN {c}" for k, c in _COUNTS.items())} END
), per AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)},
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS listed
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in KINDS)}, sha256(coalesce(listed, '')) AS base_sha256
FROM documents d LEFT JOIN per p ON d.doc_id = p.doc_id
"""
