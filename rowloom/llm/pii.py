"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust a score.

A kind has a pattern, a test and a base score. The places of the matches come
from cutting the text at the same pattern: the lengths of what lies between the
matches and of the matches themselves add up to code point positions. A span whose
score, raised by a context word of its kind in the ``NEAR`` code points of the text before or behind it,
reaches ``least`` is kept; one word serves all spans near it. The four base kinds pass by their test alone; the kinds
that the method adds are bank accounts (mod 97), which pass by their checksum, and
national numbers, which pass by a context word only.

A bank account number has the length of its country, so that words, codes and digits behind it are not
taken for a part of it; where the country has no known length, the longest run of whole words that leaves 1 is
taken. Accounts are proposed at every place where one can start; of those that overlap the first is kept.

Only DataFrame functions are used. Patterns are written without unbounded backtracking, so a very
long text costs time in proportion to its length; those of the base kinds match what the plain forms in the
comments match.

Defined results: a null or empty text has no spans; matches of one kind do not overlap, the first one wins, spans of
different kinds may; very long texts are read whole; repeated rows, and rows with a null id, get a row each; an empty table gives
no rows; extra columns are kept, and one called like a column of a kind is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.words import fresh

NEAR = 40
RUN = 256
BLOCK = 512
LEAST = 0.5


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Characters that every text with a match holds; NULL skips the look.
    needs: str | None
    score: float
    context: tuple[str, ...]
    #: Whether the pattern takes the first character only and has the match as its group, so that matches may overlap.
    ahead: bool = False


# Kinds in the order of results, with their patterns.
BASE = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, ("mail", "contact", "write")),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, ("ip", "host", "server", "address")),
    # [0-9]([\x20-]?[0-9])+ of 16 to 19 digits
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", None, 0.8, ("card", "visa", "credit", "payment")),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, ("phone", "call", "tel", "mobile", "fax")),
)
# Characters of an account number by country.
ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_COUNTRIES = "|".join(code for codes in ACCOUNT_LENGTHS.values() for code in codes.split(" "))
_ACCOUNT = "|".join(
    [rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in ACCOUNT_LENGTHS.items()]
    + [rf"(?!{_COUNTRIES})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}"]
)
ADDED = (
    Kind("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{_ACCOUNT})(?![A-Za-z0-9])))[A-Z]", None, 0.8, ("iban", "account", "bank", "konto"), True),
    Kind("national", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.4, ("ssn", "social security", "national id")),
)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: (F.ascii(c) - 48) * (i % 2 + 1))
    return F.aggregate(values, F.lit(0), lambda total, x: total + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether a bank account number without spaces leaves 1 when divided by 97."""
    turned = F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def account(match: Column) -> Column:
    """The account number that a match begins with; NULL if there is none."""

    def passes(number: Column) -> Column:
        compact = F.replace(number, F.lit(" "), F.lit(""))
        return (F.length(compact) >= 15) & mod97(compact)

    words = F.split(match, " ")
    ends = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    other = F.try_element_at(F.filter(ends, passes), F.lit(-1))
    return F.when(match.rlike(rf"\A(?:{_COUNTRIES})"), F.when(passes(match), match)).otherwise(other)


def confirmed(kind: str, match: Column) -> Column:
    """Whether a match of the pattern is one of its kind."""
    if kind == "ip":
        part = "0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return match.rlike(rf"\A{part}(?:\.{part}){{3}}\z")
    if kind == "card":
        return luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _found(text: Column, kind: Kind) -> Column:
    """Matches of a pattern; an empty list where the text lacks the characters every match has."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(int(kind.ahead)))
    if kind.needs is None:
        return matches
    return F.when(F.contains(text, F.lit(kind.needs)), matches).otherwise(F.array().cast("array<string>"))


def _account_span(s: Column) -> Column:
    match = account(s["match"])
    return F.struct(s["start"], (s["start"] + F.length(match)).alias("stop"), match.alias("match"))


def _apart(spans: Column, none: Column) -> Column:
    """The spans that have a match, in order, without those that overlap one kept before."""
    found = F.filter(spans, lambda s: s["match"].isNotNull())
    nexts = F.slice(found, 2, F.greatest(F.size(found), F.lit(1)))
    overlap = F.exists(F.zip_with(found, nexts, lambda a, b: b["start"] < a["stop"]), lambda x: F.coalesce(x, F.lit(False)))
    first = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(state: Column, s: Column) -> Column:
        kept = F.struct(s["stop"].alias("at"), F.concat(state["spans"], F.array(s)).alias("spans"))
        return F.when(s["start"] < state["at"], state).otherwise(kept)

    return F.when(overlap, F.aggregate(found, first, step, lambda state: state["spans"])).otherwise(found)


def _placed(text: Column, matches: Column, kind: Kind, near: int, least: float) -> Column:
    """Confirmed spans (start, stop, match, score) of the matches, in order.

    Lengths are added up in runs of ``RUN`` matches, so that a text with very
    many costs little more than in proportion.
    """
    gaps = F.split(text, kind.pattern, -1)

    def piece(gap: Column, match: Column) -> Column:
        taken = F.when(match.isNotNull(), 1) if kind.ahead else F.length(match)
        return F.struct(F.length(gap).alias("gap"), taken.alias("length"), match.alias("match"))

    pieces = F.filter(F.zip_with(gaps, matches, piece), lambda x: x["match"].isNotNull())
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / RUN).cast("int")), lambda i: F.slice(pieces, i * RUN + 1, RUN))
    sizes = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda total, x: total + x["gap"] + x["length"]))
    begins = F.aggregate(sizes, F.array(F.lit(0)), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)))
    none = F.array().cast("array<struct<start:int,stop:int,match:string>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        stop = start + x["length"]
        span = F.struct(start.alias("start"), stop.alias("stop"), x["match"].alias("match"))
        return F.struct(stop.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def walk(pair: Column) -> Column:
        return F.aggregate(pair["run"], F.struct(pair["begin"].alias("at"), none.alias("spans")), step, lambda state: state["spans"])

    paired = F.zip_with(runs, F.slice(begins, 1, F.size(matches)), lambda run, begin: F.struct(run.alias("run"), begin.alias("begin")))
    paired = F.filter(paired, lambda x: x["run"].isNotNull())
    spans = F.flatten(F.transform(paired, walk))
    spans = _apart(F.transform(spans, _account_span), none) if kind.ahead else F.filter(spans, lambda s: confirmed(kind.name, s["match"]))
    words = rf"\b(?:{'|'.join(kind.context)})"
    size = max(BLOCK, near + 1)
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))

    def between(start: Column, stop: Column) -> Column:
        """At most ``size`` code points of the text, read from the two blocks that hold them."""
        first = F.floor(start / size).cast("int")
        return F.array_join(F.slice(blocks, first + 1, 2), "").substr(start - first * size + 1, stop - start)

    def scored(s: Column) -> Column:
        # the code point next to the window shows whether a word begins or goes on there
        before = F.lower(between(F.greatest(s["start"] - near - 1, F.lit(0)), s["start"]))
        behind = F.lower(between(s["stop"], s["stop"] + near))
        named = F.when(s["start"] > near, before.rlike(rf"(?s)\A.+?{words}")).otherwise(before.rlike(words))
        raised = F.when(named | behind.rlike(words), 0.2).otherwise(0.0)
        return F.struct(s["start"], s["stop"], s["match"], F.least(F.lit(1.0), F.lit(kind.score) + raised).alias("score"))

    return F.filter(F.transform(spans, scored), lambda s: s["score"] >= least)


def spans(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = BASE + ADDED, near: int = NEAR, least: float = LEAST) -> DataFrame:
    """All columns, and for each kind a column ``pii_<kind>``: array of (start, stop, match, score), end exclusive."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = docs.withColumns({f"pii_{k.name}": _found(whole, k) for k in kinds})
    empty = F.array().cast("array<struct<start:int,stop:int,match:string,score:double>>")
    return found.withColumns({
        f"pii_{k.name}": F.when(F.size(f"pii_{k.name}") > 0, _placed(whole, F.col(f"pii_{k.name}"), k, near, least)).otherwise(empty)
        for k in kinds
    })


def listed(kinds: tuple[Kind, ...]) -> Column:
    """kind:start:end of all spans, by kind and start, joined by commas."""

    def written(name: str):
        return lambda s: F.concat_ws(":", F.lit(name), s["start"].cast("string"), s["stop"].cast("string"))

    return F.array_join(reduce(F.concat, [F.transform(F.col(f"pii_{k.name}"), written(k.name)) for k in kinds]), ",")


def masked(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = BASE + ADDED) -> DataFrame:
    """All columns, ``text`` with each kept span replaced by its kind in angle brackets; overlapping spans become one."""
    kept = fresh(docs.columns, "_whole")
    found = spans(docs.withColumn(kept, F.col(f"`{text}`")), text, kinds)

    def labelled(name: str):
        return lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(f"<{name}>").alias("label"))

    every = F.array_sort(reduce(F.concat, [F.transform(F.col(f"pii_{k.name}"), labelled(k.name)) for k in kinds]))
    whole = F.col(kept)
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = whole.substr(state["at"] + 1, s["start"] - state["at"])
        covered = s["start"] < state["at"]
        return F.struct(
            F.greatest(state["at"], s["stop"]).alias("at"),
            F.when(covered, state["out"]).otherwise(F.concat(state["out"], gap, s["label"])).alias("out"),
        )

    made = F.aggregate(every, first, step, lambda state: F.concat(state["out"], whole.substr(state["at"] + 1, F.length(whole) - state["at"])))
    return found.withColumn(text, F.when(whole.isNotNull(), made)).drop(kept, *[f"pii_{k.name}" for k in kinds])
