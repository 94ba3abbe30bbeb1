"""Personal data: base patterns and information-theoretic sanitisation, with DataFrame functions only.

Protected entities are the distinct values that the base patterns find.  The
corpus tells how strongly a term reveals an entity c: of N documents n(c) hold
it, n(t) hold the term t, and n(c, t) both.  With the smoothed estimate
p(c | t) = (n(c, t) + n(c) / N) / (n(t) + 1), the mutual information of term and
entity is log2(p(c | t) N / n(c)), and the doubt that is left about the entity
once the term is known is log2(N / n(c)) less this, log2(1 / p(c | t)) bits.  In all
documents with the entity, a term that leaves GENERALISE bits or less is
generalised, one that leaves REMOVE or less is removed, wherever it stands.  It
counts only if so many meetings are unlikely by chance: exp(-n(t) KL) is at most
CHANCE, KL being the divergence of n(c, t) / n(t) from n(c) / N.  So a word that is
in no document but the one with the entity is generalised in any corpus of
more than 1 / CHANCE documents, and nothing is in a smaller one.

Terms are runs of letters outside of e-mail addresses, in lower case.  Null texts
are empty.  Copies of a text are documents of their own and get the same spans.
Entities that one text alone holds stand for each other there.  A very long text
with m matches of one kind takes of the order of m * m steps.  An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioweave.llm.common import whole, with_new_text
from biblioweave.session import materialise

GENERALISE = 1.0
REMOVE = 0.25
CHANCE = 0.01
TERM = r"\p{L}[\p{L}'-]*+"

# The base patterns, written so that no run of characters is read from each of its places again:
# a match may begin where a run begins, or where the match before it ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must have for a match to be possible.
HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
KINDS = list(PATTERNS)
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"


def _luhn(digits: Column) -> Column:
    """Whether the last digit is the check digit of the others."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))
    ))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(_IP)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _with_places(df: DataFrame, text: str, pattern: str, hint: Column, kind: str, name: str) -> DataFrame:
    """Column ``name``: the leftmost matches of a pattern with their places in code points."""
    none = F.array().cast("array<string>")
    df = df.withColumns(
        {
            "_found": F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
            "_between": F.when(hint, F.split(text, pattern, -1)).otherwise(none),
        }
    )
    # what lies between matches, and the matches, follow each other
    steps = F.zip_with("_between", "_found", lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["value"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    met = F.filter(steps, lambda x: x["value"].isNotNull())
    return df.withColumn(name, F.aggregate(met, start, step, lambda acc: acc["spans"])).drop("_found", "_between")


def with_base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with _text (null as empty) and _base: the spans of the base patterns, by kind, then start."""
    df = docs.withColumn("_text", whole(F.col(text)))
    for kind, pattern in PATTERNS.items():
        df = _with_places(df, "_text", pattern, HINTS[kind](F.col("_text")), kind, f"_{kind}")
        df = df.withColumn(f"_{kind}", _kept(kind))
    return df.withColumn("_base", F.concat(*[f"_{k}" for k in KINDS])).drop(*[f"_{k}" for k in KINDS])


def _kept(kind: str) -> Column:
    return F.filter(f"_{kind}", lambda s: _passes(kind, s["value"]))


def _terms(text: Column) -> Column:
    """The terms of a text in lower case, those of e-mail addresses left out."""
    bare = F.when(HINTS["email"](text), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.regexp_extract_all(F.lower(bare), F.lit(TERM), F.lit(0))


def _involved(docs: DataFrame) -> DataFrame:
    """Written table of the distinct texts with an entity: key, copies, _text and its entities."""
    some = with_base_spans(docs).where(F.size("_base") > 0)
    entities = F.array_distinct(F.transform("_base", lambda b: F.concat_ws(":", b["kind"], b["value"])))
    keyed = some.select(F.md5("_text").alias("key"), "_text", entities.alias("entities"))
    once = keyed.groupBy("key").agg(F.count("*").alias("copies"), F.first("_text").alias("_text"), F.first("entities").alias("entities"))
    return materialise(once, "texts-with-entities")


def disclosing_terms(docs: DataFrame, involved: DataFrame, text: str = "text", generalise: float = GENERALISE, chance: float = CHANCE) -> DataFrame:
    """Written table of key (of a text), entity, term and revealed, the estimate of p(c | t), for all terms to change.

    An entity that no other text holds is named by the text's key.
    """
    total = float(max(1, docs.count()))
    least = 2.0**-generalise
    counted = docs.select(F.explode(F.array_distinct(_terms(whole(F.col(text))))).alias("term")).groupBy("term").agg(F.count("*").alias("with_term"))
    own = involved.select("key", "copies", F.explode(F.array_distinct(_terms(F.col("_text")))).alias("term"))
    held = involved.select("key", "copies", F.explode("entities").alias("entity"))
    sizes = held.groupBy("entity").agg(F.sum("copies").alias("with_entity"))
    alone = F.col("with_entity") == F.col("copies")
    named = held.join(sizes, "entity").select("key", F.when(alone, F.col("key")).otherwise(F.col("entity")).alias("entity"), "with_entity").distinct()
    # no more documents can hold both than hold the entity, so frequent terms go before they meet it
    most = F.col("with_entity") * (1 + 1 / F.lit(total))
    met = own.join(counted, "term").join(named, "key").where(most >= least * (F.col("with_term") + 1))
    met = materialise(met.select("key", "copies", "entity", "term", "with_entity", "with_term"), "terms-met")
    both = met.groupBy("entity", "term").agg(F.sum("copies").alias("both"), F.max("with_entity").alias("c"), F.max("with_term").alias("t"))
    p, q = F.col("c") / F.lit(total), F.col("both") / F.col("t")
    rest = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    by_chance = F.exp(-F.col("t") * (q * F.log(q / p) + rest))
    telling = both.withColumn("revealed", (F.col("both") + p) / (F.col("t") + 1)).where(
        (F.col("revealed") >= least) & (q > p) & (by_chance <= chance)
    )
    told = met.select("key", "entity", "term").join(telling.select("entity", "term", "revealed"), ["entity", "term"])
    return materialise(told, "disclosing-terms")


def _places(involved: DataFrame) -> DataFrame:
    """key, term, start and end of every term of the texts, by running sums over what lies between and in the terms."""
    none = F.array().cast("array<string>")
    split = involved.select("key", F.split("_text", TERM, -1).alias("gaps"), F.regexp_extract_all("_text", F.lit(TERM), F.lit(0)).alias("found"))
    steps = F.zip_with("gaps", F.coalesce("found", none), lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")))
    rows = split.select("key", F.posexplode(steps).alias("at", "x")).where("x.value IS NOT NULL")
    order = Window.partitionBy("key").orderBy("at")
    end = F.sum(F.col("x.gap") + F.length("x.value")).over(order).cast("int")
    return rows.select("key", F.lower("x.value").alias("term"), (end - F.length("x.value")).alias("start"), end.alias("end"))


def find_personal_data(
    docs: DataFrame, text: str = "text", generalise: float = GENERALISE, remove: float = REMOVE, chance: float = CHANCE
) -> DataFrame:
    """``docs`` with _text, _base and _extra: base spans, and terms to generalise (kind term) or remove (kind removed)."""
    plain = docs.select(F.col(text).alias("text"))
    involved = _involved(plain)
    telling = disclosing_terms(plain, involved, "text", generalise, chance)
    best = telling.groupBy("key", "term").agg(F.max("revealed").alias("revealed"))
    chosen = involved.join(best.select("key").distinct(), "key", "left_semi")
    kind = F.when(F.col("revealed") >= 2.0**-remove, "removed").otherwise("term")
    span = F.struct(kind.alias("kind"), "start", "end", F.lit("").alias("value"))
    placed = _places(chosen).join(best, ["key", "term"])
    extra = materialise(placed.groupBy("key").agg(F.array_sort(F.collect_list(span)).alias("_marked")), "extra-spans")
    found = with_base_spans(docs, text)
    keyed = found.withColumn("_key", F.when(F.size("_base") > 0, F.md5("_text")))
    keyed = keyed.join(extra.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")
    free = F.filter("_marked", lambda m: ~F.exists("_base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return keyed.withColumn("_extra", F.coalesce(free, F.array().cast(SPAN))).drop("_marked")


def as_text(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def sanitise(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets, removed terms by nothing; n_chars renewed if there.

    Of overlapping spans the first stands for all.
    """
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_given"))
    found = find_personal_data(packed, "_given", **limits)
    place = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    found = found.withColumn("_spans", F.array_sort(F.transform(F.concat("_base", "_extra"), place)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        label = F.when(s["kind"] == "removed", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        kept = F.concat(acc["out"], F.substring("_text", acc["at"] + 1, s["start"] - acc["at"]), label)
        out = F.when(s["start"] >= acc["at"], kept).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    def finish(acc):
        return F.concat(acc["out"], F.substring("_text", acc["at"] + 1, F.length("_text")))

    clean = F.when(F.size("_spans") > 0, F.aggregate("_spans", start, step, finish)).otherwise(F.col("_text"))
    return with_new_text(found.withColumn("_clean", clean), docs.columns, text)
