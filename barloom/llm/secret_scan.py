"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong findings (assignments, access identifiers, long hexadecimal runs) always count. Weak candidates (account names,
endpoints, long mixed runs) count only where a complementary part stands within SCOPE characters: parts of a class
spread scopes over the text, overlapping scopes are merged, and an interval join on (document, class, bucket) meets
each candidate with the one scope, if any, that covers it. So the join gives at most one row per candidate and class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.shared import drop, save

SCOPE, BUCKET = 400, 4096
_NO_ID = -(1 << 63)

#: Fixed values. Strong kinds in the order that the results list them: (kind, pattern, group with the least length,
#: that length, class of part). Spans are leftmost and non-overlapping per kind; matches that fail the length are dropped.
STRONG = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "secret"),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20, "identifier"),
    ("hex", r"[0-9a-f]{24,}", 0, 24, "secret"),
]
#: Fixed values. Weak kinds: (kind, pattern, group, least length, class of part, classes of which one must be near).
WEAK = [
    ("account", r"""(?i:(user|username|login|client_?id|account_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 2, 3, "identifier", ["secret"]),
    ("mixed", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}", 0, 32, "secret", ["identifier", "endpoint"]),
    ("endpoint", r"""(?<![A-Za-z0-9+.-])[0-9+.-]*+[A-Za-z][A-Za-z0-9+.-]*+://[^\x20\x09-\x0D"'<>]+""", 0, 6, "endpoint", ["secret"]),
]
KINDS = [k[0] for k in STRONG + WEAK]
#: Of texts that may have a strong finding; the patterns with the least lengths built in.
_ANY_ASSIGN = STRONG[0][1][:-2] + "{6,})"


def _mixed(found: Column) -> Column:
    """A weak secret has a digit, a capital and a small letter."""
    return found.rlike("[0-9]") & found.rlike("[A-Z]") & found.rlike("[a-z]")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "_h": F.xxhash64(text), "_text": text})


def find_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Spans of distinct (doc_id, text): _id, _h, kind, start, end (code points, end exclusive), class.

    Positions come from the lengths of what a pattern matches and of what it leaves, in turn, summed over a window of
    the document. Null texts have no span; equal rows share theirs (_id is doc_id, the least long for null; _h is the
    text's hash); an empty table gives an empty result.
    """
    text = F.col("_text")
    strong = text.rlike(_ANY_ASSIGN) | (text.contains("AKIA") & text.rlike(STRONG[1][1])) | text.rlike(STRONG[2][1])
    weak = text.rlike(WEAK[1][1]) & (text.contains("://") | text.rlike(WEAK[0][1]))
    some = _keyed(docs).where(strong | weak).select("_id", "_h", "_text").dropDuplicates(["_id", "_h"])
    some = save(some, "texts")
    rows = []
    for kind, pattern, group, least, part in [k[:5] for k in STRONG + WEAK]:
        found = F.regexp_extract_all("_text", F.lit(f"({pattern})"), F.lit(0))
        value = F.regexp_extract_all("_text", F.lit(pattern), F.lit(group)) if group else found
        gaps = F.transform(F.split("_text", pattern, -1), lambda x: F.length(x))
        each = F.transform(found, lambda m, i: F.struct(F.get(gaps, i).alias("gap"), F.length(m).alias("n"), (F.length(F.get("_values", i)) >= least).alias("ok") if kind != "mixed" else _mixed(m).alias("ok")))
        few = some.where(text.rlike(pattern)).withColumn("_values", value)
        rows.append(few.select("_id", "_h", F.lit(kind).alias("kind"), F.lit(part).alias("class"), F.posexplode(each).alias("i", "m")))
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    before = Window.partitionBy("_id", "_h", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.n")).over(before)
    parts = every.withColumn("end", end).where("m.ok").select("_id", "_h", "kind", "class", (F.col("end") - F.col("m.n")).alias("start"), "end")
    parts = save(parts, "parts")
    # weak candidates that lie on a strong finding say nothing more
    strong_kinds = [k[0] for k in STRONG]
    firm = parts.where(F.col("kind").isin(strong_kinds))
    open_ = parts.where(~F.col("kind").isin(strong_kinds))
    open_ = _outside(open_, firm, "covered", 0)
    open_ = save(open_, "weak")
    wanted = open_.select("*", F.explode(F.create_map(*[x for k in WEAK for x in (F.lit(k[0]), F.array(*map(F.lit, k[5])))])[F.col("kind")]).alias("needs"))
    scopes = _scopes(firm.unionByName(open_), ["_id", "_h", "class"], scope).withColumnRenamed("class", "needs")
    linked = _covered(wanted, scopes, ["_id", "_h", "needs"]).select(*parts.columns).distinct()
    out = save(firm.unionByName(linked), "spans")
    drop(some, parts, open_)
    return out


def _scopes(parts: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Disjoint intervals (lo, hi) per keys: the parts' spans widened by reach, merged where they touch; by buckets."""
    by_start = Window.partitionBy(*keys).orderBy("lo", "hi")
    wide = parts.select(*keys, F.greatest(F.col("start") - reach, F.lit(0)).alias("lo"), (F.col("end") + reach).alias("hi"))
    known = F.max("hi").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    fresh = wide.withColumn("fresh", F.when(F.col("lo") <= known, 0).otherwise(1))
    island = fresh.withColumn("island", F.sum("fresh").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    merged = island.groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    bucket = F.sequence(F.floor(F.col("lo") / BUCKET), F.floor(F.col("hi") / BUCKET))
    return merged.select(*keys, "lo", "hi", F.explode(bucket).alias("bucket"))


def _covered(parts: DataFrame, scopes: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """Interval join: parts whose start lies in a scope of the same keys (left_anti: in none)."""
    p, s = parts.withColumn("bucket", F.floor(F.col("start") / BUCKET)), scopes
    same = [p[k] == s[k] for k in [*keys, "bucket"]]
    on = same[0]
    for c in [*same[1:], p["start"] >= s["lo"], p["start"] < s["hi"]]:
        on = on & c
    return p.join(s, on, how).drop("bucket")


def _outside(parts: DataFrame, others: DataFrame, tag: str, reach: int) -> DataFrame:
    """parts that do not start within a span of others in the same document."""
    return _covered(parts, _scopes(others, ["_id", "_h"], reach), ["_id", "_h"], "left_anti")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of docs: doc_id, n_<kind> of every kind, base_sha256 (of the strong spans), spans (all of them).

    Spans are written kind:start:end, by start, then kind in the order of KINDS, joined by commas. Null texts are empty;
    repeated rows are scanned each; texts are taken whole; an empty table gives an empty result. Only doc_id and text
    are read, whatever else is there.
    """
    spans = find_spans(docs, scope)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    one = F.concat_ws(":", "kind", "start", "end")
    per = spans.select("_id", "_h", "kind", F.struct(F.col("start").alias("a"), rank.alias("r"), one.alias("s")).alias("x")).groupBy("_id", "_h")
    firm = F.col("kind").isin([k[0] for k in STRONG])

    def joined(some: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(some)), lambda x: x["s"]), ",")

    per = per.agg(joined(F.when(firm, F.col("x"))).alias("base"), joined(F.col("x")).alias("spans"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS])
    per = save(per, "per_text").withColumnsRenamed({"_id": "_id2", "_h": "_h2"})
    drop(spans)
    all_ = _keyed(docs.select("doc_id", "text")).select("doc_id", "_id", "_h")
    out = all_.join(per, (all_["_id"] == per["_id2"]) & (all_["_h"] == per["_h2"]), "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame, scope: int = SCOPE, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span's characters replaced by mask (overlapping spans once); n_chars is set anew where text changes.

    All other columns stay, whatever their names. Null texts stay null; repeated rows are masked each; texts are taken
    whole, however long; an empty table gives an empty result.
    """
    merged = _scopes(find_spans(docs.select("doc_id", "text"), scope), ["_id", "_h"], 0).select("_id", "_h", "lo", "hi").distinct()
    cuts = merged.groupBy("_id", "_h").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("_cuts"))
    cuts = save(cuts, "cuts").withColumnsRenamed({"_id": "_id2", "_h": "_h2"})
    keyed = _keyed(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")))
    both = keyed.join(cuts, (keyed["_id"] == cuts["_id2"]) & (keyed["_h"] == cuts["_h2"]), "left")

    def piece(c: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get("_cuts", i - 1)["hi"]).otherwise(0)
        return F.substring("_text", before.cast("int") + 1, (c["lo"] - before).cast("int"))

    rest = F.substring("_text", F.element_at("_cuts", -1)["hi"].cast("int") + 1, F.length("_text"))
    found = F.col("_cuts").isNotNull()
    new = F.when(found, F.concat(F.array_join(F.transform("_cuts", piece), mask), F.lit(mask), rest)).otherwise(F.col("text"))

    def column(c: str) -> Column:
        old = F.col("_row").getField(c)
        changed = {"text": F.col("_new"), "n_chars": F.length("_new").cast("long")}.get(c.lower())
        return (old if changed is None else F.when(found, changed).otherwise(old)).alias(c)

    return both.withColumn("_new", new).select(*[column(c) for c in docs.columns])
