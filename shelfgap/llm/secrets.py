"""Secret scan: keyword and token patterns plus sliding-window entropy, in built-in functions.

Positions are code points.  They come from splitting a text at its matches:
the pieces between matches and the matches themselves, in turn, give every start.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# fixed values: the base patterns, by kind
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# the same matches as ACCESS and HEX once those that are too short are dropped: a match takes its whole
# run of characters, so a run that is too short holds no other match
ACCESS_LONG = r"AKIA[A-Z0-9]{12,}"
HEX_LONG = r"[0-9a-f]{32,}"
MIN_ASSIGN = 8


@dataclass(frozen=True)
class EntropyClass:
    """A character class whose runs are candidates, and the entropy at which a window is a secret."""
    name: str
    chars: str               # inside of a regular expression's brackets
    window: int
    min_bits: float
    needs: tuple[str, ...]   # patterns that a candidate must also match, all of them
    tail: str = ""           # what may follow a run of the characters

    @property
    def run(self) -> str:
        return f"[{self.chars}]{{{self.window},}}{self.tail}"


CLASSES = (
    EntropyClass("ent_hex", "0-9a-fA-F", 20, 3.0, ("[0-9]",)),
    EntropyClass("ent_b64", "A-Za-z0-9+/_-", 20, 3.6, ("[0-9]", "[A-Z]", "[a-z]"), "={0,2}"),
    EntropyClass("ent_upper", "A-Z0-9", 20, 3.4, ("[0-9]", "[A-Z]")),
    EntropyClass("ent_lower", "a-z0-9", 20, 3.4, ("[0-9].*[0-9]", "[a-z]")),
)
# well-known harmless runs: UUIDs, numbers, path- or word-like runs
ALLOW = (r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"^[0-9]+$",
         r"^[A-Za-z]+([_/-][A-Za-z]+)*$")
# well-known harmless parts of runs, in either case: example keys, alphabets and digit rows
ALLOW_PARTS = "(?i)example|0123456789|abcdefghij|qwertyuiop"
SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def _spans(text: Column, pattern: str, kind: str, rank: int, keep, group: int = 0) -> Column:
    """All leftmost non-overlapping matches as spans, but for those whose group fails ``keep``."""
    found = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                       F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
                       lambda m, g: F.struct(F.length(m).alias("n"), g.alias("g")))
    # the last piece has no match after it
    parts = F.zip_with(F.split(text, pattern, -1), found,
                       lambda piece, m: F.struct(F.length(piece).alias("gap"), m.alias("m")))
    zero = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("out"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["m"]["n"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                        end.alias("end"))
        return F.struct(F.coalesce(end, start).alias("at"),
                        F.when(x["m"].isNotNull() & keep(x["m"]["g"]), F.concat(state["out"], F.array(span)))
                        .otherwise(state["out"]).alias("out"))

    return F.aggregate(parts, zero, step)["out"]


def _clog(c: Column) -> Column:
    """c log2 c, with 0 for c = 0."""
    return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def max_window_bits(run: Column, window: int) -> Column:
    """Largest Shannon entropy, in bits, over all windows of the run (0 if it is shorter).

    A window keeps a count per character and s = sum of c log2 c; moving by one
    character changes two counts and two terms of s.  Entropy is log2 w - s / w.
    """
    chars = F.filter(F.split(run, ""), lambda c: c != "")
    leaving = F.concat(F.array_repeat(F.lit(None).cast("string"), window), chars)
    moves = F.filter(F.zip_with(chars, leaving, lambda i, o: F.struct(i.alias("i"), o.alias("o"))),
                     lambda x: x["i"].isNotNull())
    zero = F.struct(F.expr("cast(map() as map<string,int>)").alias("counts"), F.lit(0).alias("n"),
                    F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))

    def bump(st: Column, ch: Column, by: int) -> Column:
        c = F.coalesce(F.try_element_at(st["counts"], ch), F.lit(0))
        rest = F.map_filter(st["counts"], lambda k, _: k != ch)
        return F.struct(F.map_concat(rest, F.create_map(ch, c + by)).alias("counts"), (st["n"] + by).alias("n"),
                        (st["s"] - _clog(c) + _clog(c + by)).alias("s"), st["best"].alias("best"))

    def step(state: Column, x: Column) -> Column:
        # arrays of one element, so that a lambda variable holds the state between the moves
        entered = F.transform(F.array(state), lambda st: bump(st, x["i"], 1))
        moved = F.transform(entered, lambda st: F.when(x["o"].isNotNull(), bump(st, x["o"], -1)).otherwise(st))
        bits = F.log2(F.lit(float(window)))
        return F.get(F.transform(moved, lambda st: F.struct(
            st["counts"].alias("counts"), st["n"].alias("n"), st["s"].alias("s"),
            F.when(st["n"] == window, F.greatest(st["best"], bits - st["s"] / window))
            .otherwise(st["best"]).alias("best"))), F.lit(0))

    return F.aggregate(moves, zero, step)["best"]


def scan(df: DataFrame, text: str = "text", classes: Sequence[EntropyClass] = CLASSES,
         allow: Sequence[str] = ALLOW, allow_parts: str = ALLOW_PARTS) -> DataFrame:
    """The input's rows with ``base_spans`` and ``spans``: arrays of (start, rank, kind, end).

    Base spans are the matches of the three patterns.  The method adds the runs
    of each class's characters in which some window reaches the class's
    entropy, unless the run matches an allow-list pattern or lies inside a
    span found already.  No window reaches into an allowed part, so such a part
    hides itself alone, not the secret beside it.  Spans are ordered by start,
    then kind.

    Only texts in which a quick test finds a pattern or candidate pay for
    spans.  Null and empty texts have no spans; texts of any length are scanned
    whole; repeated rows each get a result; an empty table gives an empty
    result.  Input columns named like the two results are replaced.
    """
    t = text_or_empty(text)
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    every = lambda _: F.lit(True)
    base = F.concat(
        F.when(t.rlike(ASSIGN), _spans(t, ASSIGN, "assign", 0, lambda g: F.length(g) >= MIN_ASSIGN, 2))
        .otherwise(none),
        F.when(t.rlike(ACCESS_LONG), _spans(t, ACCESS_LONG, "access", 1, every)).otherwise(none),
        F.when(t.rlike(HEX_LONG), _spans(t, HEX_LONG, "hex", 2, every)).otherwise(none))
    out = df.withColumn("base_spans", F.array_sort(base))

    def kept(c: EntropyClass):
        def keep(match: Column) -> Column:
            ok = F.lit(True)
            for pattern in c.needs:
                ok = ok & match.rlike(pattern)
            for pattern in allow:
                ok = ok & ~match.rlike(pattern)
            strong = F.exists(F.split(match, allow_parts), lambda x: F.when(
                F.length(x) >= c.window, max_window_bits(x, c.window) >= c.min_bits).otherwise(F.lit(False)))
            return F.when(ok, strong).otherwise(F.lit(False))
        return keep

    def outside(seen: Column):
        return lambda s: ~F.exists(seen, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))

    added = none
    for rank, c in enumerate(classes, 3):
        own = F.when(t.rlike(c.run), _spans(t, c.run, c.name, rank, kept(c))).otherwise(none)
        added = F.concat(added, F.filter(own, outside(F.concat(F.col("base_spans"), added))))
    return out.withColumn("spans", F.array_sort(F.concat(F.col("base_spans"), added)))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(df: DataFrame, text: str = "text", mask: str = "[secret]", **options) -> DataFrame:
    """The input with each run of found spans replaced by ``mask`` (overlapping spans count as one)."""
    found = scan(df, text, **options)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    t = text_or_empty(text)

    def step(state: Column, s: Column) -> Column:
        fresh = F.concat(state["out"], F.substring(t, state["at"] + 1, s["start"] - state["at"]), F.lit(mask))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= state["at"], fresh).otherwise(state["out"]).alias("out"))

    done = F.aggregate("spans", zero, step)
    return (found.withColumn(text, F.when(F.size("spans") > 0, F.concat(
        done["out"], F.substring(t, done["at"] + 1, F.length(t)))).otherwise(F.col(text)))
        .drop("base_spans", "spans"))
