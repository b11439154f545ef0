"""Quotation linking of conversations: nested quote levels, hashed passages, originals, reply order.

Quotes are cut into units: the whole, its paragraphs, lines, sentences and runs of RUN words. A message is indexed by the
units of its own text, of the runs by every RUN-th only, and a quote asks for all its runs: so whatever a client trims or
wraps anew, a quote of 2 * RUN - 1 words in a row of a message finds it. Units are normalised and hashed; what follows
are joins on hashes.

Replies form trees. Their order is the preorder of the trees: a list of the steps down to a message and back up, ranked
by pointer doubling, so no tree and no conversation is ever gathered.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import drop, numbered, save, small_batches
from barloom.llm.tokens import text_slices

RUN = 8
FEWEST = 5  # words of a unit that may link to another conversation
_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: How a line that introduces a quotation begins and ends, by language.
_SAYS = [(r"On\b", r"\bwrote\s*:"), (r"Am\b", r"\bschrieb\b.*:"), (r"Le\b", r"\ba écrit\s*:"), (r"El\b", r"\bescribió\s*:")]
_INTRODUCES = re.compile("|".join(f"(?:{a}.*{b})" for a, b in _SAYS), re.DOTALL)
_OPENS = re.compile("|".join(a for a, _ in _SAYS))
_NULL = -(1 << 63)


def normalise(passage: str) -> str:
    """Lower case, white space runs as one space, none at the ends."""
    return " ".join(passage.lower().split())


def digest(passage: str) -> str:
    return xxhash.xxh3_128_hexdigest(passage.encode("utf-8", "replace"))


def units(passage: str, step: int) -> list[tuple[int, int, str]]:
    """(kind, words, hash) of a passage's distinct units, the most telling kinds first; runs start at every step-th word.

    Kinds: 0 the whole, 1 a paragraph, 2 a line, 3 a sentence of three words or more, 4 a run of RUN words.
    """
    words = passage.lower().split()
    paragraphs = re.split(r"\n[ \t]*\n", passage)
    sentences = [x for p in paragraphs for x in _SENTENCE.split(p.strip()) if len(x.split()) >= 3]
    kinds = [[passage], paragraphs, passage.split("\n"), sentences, (" ".join(words[i : i + RUN]) for i in range(0, len(words) - RUN + 1, step))]
    found: dict[str, tuple[int, int]] = {}
    for kind, passages in enumerate(kinds):
        for x in map(normalise, passages):
            if x:
                found.setdefault(digest(x), (kind, x.count(" ") + 1))
    return [(kind, n, h) for h, (kind, n) in found.items()]


def without_introduction(lines: list[str]) -> list[str]:
    """lines without the one that introduces a quotation after them, on however many lines it is wrapped."""
    last = max((i for i, x in enumerate(lines) if x.strip()), default=-1)
    first = last
    while first >= 0 and lines[first].strip():
        if _OPENS.match(lines[first].strip()) and _INTRODUCES.fullmatch(" ".join(x.strip() for x in lines[first : last + 1])):
            return lines[:first]
        first -= 1
    return lines


def parse(text: str | None) -> tuple[str, list[str], list[tuple[int, list[tuple[int, int, str]]]]]:
    """(text without quotes, hashes of its own units, quotes as (level, units) in order) of a message."""
    runs: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        found = _MARKS.match(line)
        level, rest = (found[1].count(">"), line[found.end() :]) if found else (0, line)
        if runs and runs[-1][0] == level:
            runs[-1][1].append(rest)
        else:
            runs.append((level, [rest]))
    runs = [(level, without_introduction(lines) if level == 0 and nxt else lines) for (level, lines), (nxt, _) in zip(runs, [*runs[1:], (0, [])])]
    own = [x for level, lines in runs if level == 0 for x in ["\n".join(lines)] if x.strip()]
    kept = "\n".join(own).strip("\n") if any(level for level, _ in runs) else (text or "")
    own_units = list(dict.fromkeys(h for x in [kept, *own] for _, _, h in units(x, RUN)))
    quotes = [(level, u) for level, lines in runs if level for u in [units("\n".join(lines), 1)] if u]
    return kept, own_units, quotes


UNIT = "struct<kind:int, n:int, hash:string>"
PARSED = f"msg long, conv_id long, turn long, role string, body string, own array<string>, quotes array<struct<level:int, units:array<{UNIT}>>>"
_KIND = pa.list_(pa.struct([("level", pa.int32()), ("units", pa.list_(pa.struct([("kind", pa.int32()), ("n", pa.int32()), ("hash", pa.string())])))]))


def _parsed(messages: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at, n in text_slices(batch.column("text")):
                part = batch.slice(at, n)
                rows = [parse(x) for x in part.column("text").to_pylist()]
                quotes = [[{"level": a, "units": [dict(zip(("kind", "n", "hash"), x)) for x in b]} for a, b in q] for _, _, q in rows]
                made = [pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.list_(pa.string())), pa.array(quotes, _KIND)]
                same = [part.column(c) for c in ("msg", "conv_id", "turn", "role")]
                yield pa.RecordBatch.from_arrays([*same, *made], ["msg", "conv_id", "turn", "role", "body", "own", "quotes"])

    long = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(_NULL)).alias(c)
    keyed = messages.select(F.monotonically_increasing_id().alias("msg"), long("conv_id"), long("turn"), F.col("role").cast("string"), "text")
    with small_batches(messages.sparkSession):
        return save(keyed.mapInArrow(run, PARSED), "messages")


def _parents(parsed: DataFrame) -> DataFrame:
    """Saved table of the messages whose quotes have originals: msg, parent (that message), its conversation and turn, n_linked."""
    quotes = parsed.where(F.size("quotes") > 0).select("msg", "conv_id", "turn", F.posexplode("quotes").alias("q", "quote"))
    asked = quotes.select("msg", "conv_id", "turn", "q", "quote.level", F.posexplode("quote.units").alias("unit", "u"))
    asked = save(asked.select("msg", "conv_id", "turn", "q", "level", "unit", "u.kind", "u.n", "u.hash"), "quotes")
    own = parsed.select("msg", "conv_id", "turn", F.explode("own").alias("hash"))
    first = own.groupBy("conv_id", "hash").agg(F.min(F.struct("turn", "msg")).alias("origin"))
    first = save(first.join(asked.select("hash").distinct(), "hash", "left_semi"), "originals")
    place = F.struct("conv_id", F.col("origin.turn").alias("turn"), F.col("origin.msg").alias("msg"))
    ends = save(first.groupBy("hash").agg(F.min(place).alias("a"), F.max(place).alias("b")), "anywhere")
    here = asked.join(first, ["conv_id", "hash"]).where("origin.turn < turn")
    here = here.select("msg", "q", "level", F.lit(0).alias("away"), "kind", "unit", F.struct("conv_id", "origin.turn", "origin.msg").alias("at"))
    far = asked.where(F.col("n") >= FEWEST).join(ends, "hash")
    other = F.when(F.col("a.conv_id") != F.col("conv_id"), F.col("a")).when(F.col("b.conv_id") != F.col("conv_id"), F.col("b"))
    far = far.select("msg", "q", "level", F.lit(1).alias("away"), "kind", "unit", other.alias("at")).where("at IS NOT NULL")
    per_quote = here.unionByName(far).groupBy("msg", "q", "level").agg(F.min(F.struct("away", "kind", "unit", "at")).alias("best"))
    one = F.min(F.struct("best.away", "level", "q", "best.at")).alias("p")
    per_message = per_quote.groupBy("msg").agg(one, F.count("*").alias("n_linked"))
    linked = per_message.select("msg", F.col("p.at.msg").alias("parent"), F.col("p.at.conv_id").alias("parent_conv"), F.col("p.at.turn").alias("parent_turn"), (F.col("p.away") == 0).alias("inside"), "n_linked")
    linked = save(linked, "linked")
    drop(asked, first, ends)
    return linked


def _doubled(table: DataFrame, key: str, to: str, add: dict[str, str]) -> DataFrame:
    """Follows ``to`` up to its end (null or a key that is not there), adding up columns on the way; log2(longest) joins.

    add maps each summed column to its name; ``to`` ends as the last key reached.
    """
    now = table
    while True:
        b = now.select(F.col(key).alias("_k"), F.col(to).alias("_to"), *[F.col(c).alias(f"_{c}") for c in add])
        sums = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in add]
        keep = [c for c in now.columns if c not in (key, to, "moved", *add)]
        far = now.drop("moved").join(b, now[to] == b["_k"], "left")
        nxt = save(far.select(key, *keep, F.coalesce("_to", to).alias(to), *sums, F.col("_to").isNotNull().alias("moved")), "doubled")
        drop(now)
        now = nxt
        if now.where("moved").isEmpty():
            return now


def _trees(parsed: DataFrame, linked: DataFrame) -> DataFrame:
    """Saved table of the messages in trees of two or more: msg, root, depth, rank (the greater, the earlier in preorder)."""
    up = save(linked.where("inside").select("msg", F.col("parent").alias("root"), F.lit(1).alias("depth")), "up")
    up = _doubled(up, "msg", "root", {"depth": "depth"})
    edges = linked.where("inside").select("msg", "parent").join(parsed.select("msg", "turn"), "msg")
    placed = numbered(edges, ["parent", "turn", "msg"], "n")
    siblings = save(placed, "siblings")
    after = siblings.select(F.col("parent").alias("p2"), (F.col("n") - 1).alias("n2"), F.col("msg").alias("next"))
    down, back = (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
    paired = siblings.join(after, (siblings["n"] == after["n2"]) & (siblings["parent"] == after["p2"]), "left")
    ups = paired.select(back("msg").alias("e"), F.coalesce(down("next"), back("parent")).alias("to"), F.lit(0).alias("rank"))
    first = siblings.groupBy("parent").agg(F.min_by("msg", "n").alias("child"))
    members = up.select("msg").unionByName(up.select(F.col("root").alias("msg"))).distinct()
    downs = members.join(first, members["msg"] == first["parent"], "left")
    downs = downs.select(down("msg").alias("e"), F.coalesce(down("child"), back("msg")).alias("to"), F.lit(1).alias("rank"))
    tour = save(ups.unionByName(downs), "tour")
    ranks = _doubled(tour, "e", "to", {"rank": "rank"})
    ranked = ranks.where("e % 2 = 0").select((F.col("e") / 2).cast("long").alias("msg"), "rank")
    out = members.join(up.select("msg", "root", "depth"), "msg", "left").join(ranked, "msg")
    out = save(out.select("msg", F.coalesce("root", "msg").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"), "rank"), "trees")
    drop(placed, siblings, ranks, up)
    return out


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per message in reply order: conv_id, turn, role, position, root_turn, depth, parent_conv_id, parent_turn,
    n_quotes, n_linked, body.

    A quote's original is the first message of an earlier turn of the conversation that has one of its units, by the
    most telling kind of unit; if there is none, a message of another conversation with a unit of FEWEST words or more
    (the first by conversation, or the last if the first is the own). A message answers the original of its least
    nested linked quote, those of its own conversation first (the first of equals); links inside a conversation make
    trees: root_turn and depth follow them upwards, and a message without one is its own root. Order in a conversation:
    trees by the turn of their root, in each tree every message before its replies and those by turn, each with all
    that follows from it. body is the text without quotes and their introductions.

    Null conv_ids are one conversation, null turns come first, null texts are empty; rows that repeat conv_id and turn
    are messages of their own, none of them earlier than the other; an empty table gives an empty result. Texts are
    taken whole, however long. Only conv_id, turn, role and text are read, whatever else is there.
    """
    parsed = _parsed(messages)
    linked = _parents(parsed)
    lean = parsed.select("msg", "conv_id", "turn", "role", "body", F.size("quotes").cast("long").alias("n_quotes"))
    if linked.where("inside").isEmpty():
        trees = linked.select("msg", F.col("msg").alias("root"), F.lit(0).alias("depth"), F.lit(0).alias("rank")).limit(0)
    else:
        trees = _trees(parsed, linked)
    of_root = trees.join(parsed.select(F.col("msg").alias("root"), F.col("turn").alias("root_turn")), "root")
    full = lean.join(linked.select("msg", "parent_conv", "parent_turn", "n_linked"), "msg", "left").join(of_root, "msg", "left")
    zero = {"depth": F.coalesce("depth", F.lit(0)), "rank": F.coalesce("rank", F.lit(0)), "n_linked": F.coalesce("n_linked", F.lit(0).cast("long"))}
    full = full.withColumns({"root_turn": F.coalesce("root_turn", "turn"), "root": F.coalesce("root", "msg"), "back": -F.coalesce("rank", F.lit(0)), **zero})
    placed = numbered(full, ["conv_id", "root_turn", "root", "back", "msg"], "n")
    ordered = save(placed, "ordered")
    starts = ordered.groupBy("conv_id").agg(F.min("n").alias("first"))
    out = ordered.join(starts, "conv_id").withColumn("position", F.col("n") - F.col("first"))
    drop(parsed, linked, trees, placed)

    def real(c: str, name: str) -> Column:
        return F.when(F.col(c) != _NULL, F.col(c)).alias(name)

    return out.select(
        real("conv_id", "conv_id"), real("turn", "turn"), "role", "position", real("root_turn", "root_turn"), "depth",
        real("parent_conv", "parent_conv_id"), real("parent_turn", "parent_turn"), "n_quotes", "n_linked", "body",
    )
