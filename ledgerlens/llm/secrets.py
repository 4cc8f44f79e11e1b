"""Secrets in texts, with Spark expressions only.

Three kinds are patterns: assignments to telling names, access key ids, and long
hexadecimal runs. The fourth is entropy: in every run of key characters, a window
of WINDOW characters slides along with one count per character, of which each
step changes two; the Shannon entropy follows from the changed terms alone. Each
character class has its own limit: that of the window, if it has letters and digits,
else that of its run. Runs on the allow-list are left alone. Of a run that names a
listed word only the part between = / _ that holds it is, and what stands before and
behind are runs by themselves; a hyphen joins a word to its part.

Positions are code points; ends are exclusive. Matches of a kind are the leftmost
ones that do not overlap: the text is split at them, and their places follow from
the lengths of pieces and matches.

Runs are taken apart once, and every step reads its own place in them, so work grows
with the length of a text; no pattern repeats a group, which would take a frame of
the JVM's stack for every part of a long run.

Defined cases: null text is empty; other columns are kept (one named like the
result is replaced); a run of any length is one candidate; an empty table gives
no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the patterns of the kinds ----------------------------------------------------
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
# ------------------------------------------------------------------------------------------------
_LEAST_VALUE = 6
WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# Bits per character from which a window of a class is suspicious. Runs of letters alone are words.
LIMITS = {"hex": 2.9, "lower": 3.6, "mixed": 3.75}
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    r"(?i)^(sha|md)[0-9]{1,3}[-=]",  # published checksums
    r"^[A-Za-z]*[-_/]?[0-9]+$",  # a name and a number
)
JOINT, SLUG_PART = "[-_/]+", "^(?:[A-Za-z]{2,}|[0-9]{1,4})$"  # words and short numbers: paths, slugs, dates
LISTED = (r"(?i)example|sample|placeholder|dummy|changeme|xxxx|"
          r"abcdefghij|0123456789|1234567890|qwertyuiop")
_BITS, _FIELDS = 5, 12  # of a count, and counts in a whole number
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _spans(text: Column, pattern: str, matched) -> Column:
    """Spans of all matches; `matched` gives a match's own spans from (match, start)."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    state = F.struct(F.lit(0).alias("at"), _none().alias("spans"))

    def add(state, pair):
        start = state["at"] + F.length(pair["piece"])
        found = matched(pair["match"], start)
        spans = F.when(F.size(found) > 0, F.concat(state["spans"], found)).otherwise(state["spans"])
        return F.struct((start + F.length(pair["match"])).alias("at"), spans.alias("spans"))

    # the last piece has no match behind it
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(
        p.alias("piece"), m.alias("match")))
    found = F.aggregate(pairs, state, add, lambda s: s["spans"])
    return F.when(text.rlike(pattern), found).otherwise(_none())


def _whole(kind: int, keep=None):
    def spans(match, start):
        span = F.array(F.struct(
            start.cast("int").alias("start"), F.lit(kind).alias("kind"), (start + F.length(match)).cast("int").alias("end")))
        return span if keep is None else F.when(keep(match), span).otherwise(_none())

    return spans


def _each(values: Column, of) -> Column:
    """Of one value: what `of` makes of it, which reads it as often as it likes while it is worked out once."""
    return F.get(F.transform(F.array(values), of), 0)


def _slug(run: Column) -> Column:
    """Two words or short numbers at least, joined by - _ /, and nothing else."""
    return run.rlike("^[A-Za-z0-9]") & _each(
        F.filter(F.split(run, JOINT), lambda p: p != ""),
        lambda parts: (F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike(SLUG_PART)))


def _limit(run: Column) -> Column:
    """Entropy limit of a run by its character class; null for runs that are not keys."""
    allowed = ~run.rlike("[0-9]") | ~run.rlike("[A-Za-z]")
    for pattern in ALLOWED:
        allowed = allowed | run.rlike(pattern)
    return (
        F.when(allowed | _slug(run), F.lit(None).cast("double"))
        .when(run.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(LIMITS["hex"]))
        .when(~run.rlike("[A-Z]") | ~run.rlike("[a-z]"), F.lit(LIMITS["lower"]))
        .otherwise(F.lit(LIMITS["mixed"]))
    )


def _term(count: Column) -> Column:
    """count x log2(count), 0 for 0, of counts within a window."""
    return F.get(F.array(F.lit(0.0), *(F.lit(n) * F.log2(F.lit(n)) for n in range(1, WINDOW + 2))), count)


def suspicious_stretch(run: Column, limit: Column) -> Column:
    """struct<first, last>: begin of the first and end of the last window at or above its limit; nulls if there is none.

    `limit` is that of windows without letters or without digits. The counts of the
    characters in the window are fields of _BITS bits in a few whole numbers.
    """
    classes = {  # of places in ALPHABET
        "upper": lambda c: c.between(1, 26), "lower": lambda c: c.between(27, 52), "digit": lambda c: c.between(53, 62),
        "upper_hex": lambda c: c.between(1, 6), "lower_hex": lambda c: c.between(27, 32),
    }
    words = len(ALPHABET) // _FIELDS + 1
    state = F.struct(
        *(F.lit(0).alias(k) for k in classes),
        F.array_repeat(F.lit(0).cast("bigint"), words).alias("counts"), F.lit(0.0).alias("sum"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    # a character leaves WINDOW steps after it enters: the run beside itself, moved by a window
    places = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    none = F.array_repeat(F.lit(None).cast("int"), WINDOW)
    steps = _each(places, lambda chars: F.transform(
        F.zip_with(chars, F.slice(F.concat(none, chars), F.lit(1), F.size(chars)), lambda c, gone: F.struct(
            c.alias("enters"), gone.alias("leaves"))),
        lambda step, i: F.struct(
            i.alias("i"), step["enters"].alias("enters"), step["leaves"].alias("leaves"),
            F.floor(step["enters"] / _FIELDS).cast("int").alias("to"), (step["enters"] % _FIELDS * _BITS).alias("to_bit"),
            F.floor(step["leaves"] / _FIELDS).cast("int").alias("off"), (step["leaves"] % _FIELDS * _BITS).alias("off_bit"))))
    one = F.lit(1).cast("bigint")

    def count(s, word, bit):
        return F.call_function("shiftright", F.get(s["counts"], word), bit).bitwiseAND((1 << _BITS) - 1).cast("int")

    def slide(s, step):
        gains, loses = count(s, step["to"], step["to_bit"]), count(s, step["off"], step["off_bit"])
        same = step["leaves"].eqNullSafe(step["enters"])
        change = F.when(same, F.lit(0.0)).otherwise(
            _term(gains + 1) - _term(gains) + F.when(step["leaves"].isNull(), F.lit(0.0)).otherwise(
                _term(loses - 1) - _term(loses)))
        counts = F.transform(s["counts"], lambda n, k: n
                             + F.when(k == step["to"], F.call_function("shiftleft", one, step["to_bit"])).otherwise(0)
                             - F.when(k == step["off"], F.call_function("shiftleft", one, step["off_bit"])).otherwise(0))
        total = s["sum"] + change
        n = {k: s[k] + of(step["enters"]).cast("int") - F.coalesce(of(step["leaves"]).cast("int"), F.lit(0))
             for k, of in classes.items()}
        return F.struct(
            *(v.alias(k) for k, v in n.items()), counts.alias("counts"), total.alias("sum"),
            s["first"].alias("first"), s["last"].alias("last"), step["i"].alias("i"))

    def judged(s):
        """The state with the window that ends here taken in, if it is at or above its limit."""
        own = (
            F.when((s["digit"] == 0) | (s["upper"] + s["lower"] == 0), limit)
            .when((s["lower_hex"] + s["digit"] == WINDOW) | (s["upper_hex"] + s["digit"] == WINDOW), F.lit(LIMITS["hex"]))
            .when((s["upper"] == 0) | (s["lower"] == 0), F.lit(LIMITS["lower"]))
            .otherwise(F.lit(LIMITS["mixed"]))
        )
        high = (s["i"] >= WINDOW - 1) & (F.lit(math.log2(WINDOW)) - s["sum"] / WINDOW >= own)
        return F.struct(
            *(s[k].alias(k) for k in classes), s["counts"].alias("counts"), s["sum"].alias("sum"),
            F.when(high, F.coalesce(s["first"], s["i"] - (WINDOW - 1))).otherwise(s["first"]).cast("int").alias("first"),
            F.when(high, s["i"] + 1).otherwise(s["last"]).cast("int").alias("last"))

    return F.aggregate(steps, state, lambda s, step: _each(slide(s, step), judged), lambda s: F.struct(
        s["first"].alias("first"), s["last"].alias("last")))


def _unlisted(run: Column) -> Column:
    """array<struct<at, part>>: what a run has beside the parts between = / _ that hold a listed word."""
    none = F.array().cast("array<struct<at:int,part:string>>")
    whole = F.filter(F.array(F.struct(F.lit(0).alias("at"), run.alias("part"))), lambda p: F.length(p["part"]) >= WINDOW)

    def between(tokens):
        # parts and the characters that end them; listed parts by their places, and one beyond both ends
        listed = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: F.get(tokens, i).rlike(LISTED))
        ends = F.concat(F.array(F.lit(-1)), listed, F.array(F.size(tokens)))
        pieces = F.zip_with(F.slice(ends, F.lit(1), F.size(ends) - 1), F.slice(ends, F.lit(2), F.size(ends) - 1), lambda a, b: F.struct(
            F.array_join(F.slice(tokens, a + 2, b - a - 1), "").alias("part"),
            F.coalesce(F.length(F.get(tokens, b)), F.lit(0)).alias("gap")))
        return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("found")), add, lambda s: s["found"])

    def add(s, p):
        found = F.when(F.length(p["part"]) >= WINDOW, F.concat(s["found"], F.array(F.struct(
            s["at"].alias("at"), p["part"].alias("part"))))).otherwise(s["found"])
        return F.struct((s["at"] + F.length(p["part"]) + p["gap"]).alias("at"), found.alias("found"))

    cut = _each(F.split(run, "(?<=[=/_])|(?=[=/_])"), between)
    return F.when(run.rlike(LISTED), cut).otherwise(whole)


def _entropy(match: Column, start: Column) -> Column:
    def found(p):
        # behind a listed part, the character that ends it is no part of the name
        name = F.when(p["at"] > 0, F.regexp_replace(p["part"], "^[=/_]+", "")).otherwise(p["part"])
        # arrays of one, so that the name, the limit and the stretch are worked out once
        limits = F.filter(F.transform(F.array(name), _limit), lambda x: x.isNotNull())
        stretches = F.transform(limits, lambda x: suspicious_stretch(p["part"], x))
        return F.transform(F.filter(stretches, lambda s: s["first"].isNotNull()), lambda s: F.struct(
            (start + p["at"] + s["first"]).cast("int").alias("start"), F.lit(3).alias("kind"),
            (start + p["at"] + s["last"]).cast("int").alias("end")))

    return F.flatten(F.transform(_unlisted(match), found))


def found_secrets(docs: DataFrame, column: str = "text", into: str = "secrets") -> DataFrame:
    """All columns and `into`: array<struct<start, kind (number in KINDS), end>> by start, then kind."""
    text = F.coalesce(F.col(column), F.lit(""))
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= _LEAST_VALUE
    return docs.withColumn(into, F.array_sort(F.concat(
        _spans(text, ASSIGN, _whole(0, value)), _spans(text, ACCESS, _whole(1)),
        _spans(text, HEX, _whole(2)), _spans(text, CANDIDATE, _entropy))))


def of_kind(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch of overlapping spans replaced by the mark."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def cut(s, span):
        fresh = F.when((span["start"] > s["at"]) | (F.size(s["parts"]) == 0), F.array(
            F.substring(text, s["at"] + 1, span["start"] - s["at"]), F.lit(mark))).otherwise(
            F.array().cast("array<string>"))
        return F.struct(F.greatest(s["at"], span["end"]).alias("at"), F.concat(s["parts"], fresh).alias("parts"))

    done = F.aggregate(spans, state, cut, lambda s: F.concat(
        F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.lit(2**31 - 1))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
