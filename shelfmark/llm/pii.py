"""Personal data by weak supervision, in DataFrame functions alone.

Patterns of each kind give the base spans, which always stay. Candidates besides are matches that fail the check of
their kind, and matches of looser patterns: spaced, written out or set apart by other signs. Labelers
(check, gazetteer, context for and against, shape) vote on every span or abstain; expectation-maximisation over
the counts of vote patterns estimates how reliable each labeler is and the odds of each pattern; a logistic
classifier on features of the span itself is trained on those odds and decides which candidates are added.

Texts are read once; spans, with votes and features, are written and read again. All that leaves the executors
is the table of vote and feature patterns: PATTERNS rows a kind at most, whatever the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import written

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. The possessive forms find what the plain ones do, without backtracking: what follows a
#: repeat never begins with a character of it. A card has 13 digits or more, so shorter runs need no match.
BASE = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns, whose matches are candidates.
_AT, _DOT = r"[(\[{<] ?at ?[)\]}>]", r"[(\[{<] ?dot ?[)\]}>]"
LOOSE = {
    "email": rf"[A-Za-z0-9._%+-]++(?: ?{_AT} ?[A-Za-z0-9-]++(?: ?(?:\.|{_DOT}| dot ) ?[A-Za-z0-9-]++)++| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++| @ [A-Za-z0-9-]++(?: ?\. ?[A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| \. )[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+(] ?)(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])|(?<![0-9+.])00[1-9][0-9]?(?:[ .-][0-9]{2,8}){1,5}(?![0-9])",
}
#: What a text must hold for any match of a kind; it spares the others the patterns.
NEEDS = {
    "email": r"@|[(\[{<] ?at ?[)\]}>]| at [A-Za-z0-9-]+ dot ",
    "ip": r"[0-9]\.[0-9]|:[0-9A-Fa-f]{1,4}:|[0-9](?:\[\.\]|\(\.\)| \. )[0-9]",
    "card": r"[0-9](?:[\x20./_-]?[0-9]){12}",
    "phone": r"\+[0-9]|[0-9]{3}\)? ?[.-]?[0-9]{3}[.-][0-9]{4}|00[1-9][0-9]?[ .-][0-9]",
}
#: Gazetteers and context words of each kind, in lower case.
KNOWN = {
    "email": r"(?:\.|\bdot ?[)\]}>]?) ?(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?:10|127|172|192)[^0-9]|^(?:2001|fe80|fd00):",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
}
CONTEXT = {
    "email": r"\b(?:e-?mails?|mail|contact|write to|reach|correo|courriel)\b",
    "ip": r"\b(?:ip|host|server|address|adresse|login from|logged in|dirección)\b",
    "card": r"\b(?:card|visa|mastercard|amex|credit|payment|karte|carte|tarjeta)\b",
    "phone": r"\b(?:phone|tel|telephone|call|mobile|fax|cell|telefon|téléphone|teléfono)\b",
}
AGAINST = r"\b(?:version|release|build|section|chapter|isbn|issn|order|invoice|serial|part no|article|paragraph|id)\b[ .:#=]*$"
#: Shapes that a kind is written in, when its parts are set apart.
SHAPE = {
    "email": r"^[a-z][a-z0-9._%+-]*(?:@|[^a-z0-9]*\bat\b[^a-z0-9]*|[ ]@[ ])[a-z0-9-]+",
    "ip": r"^[0-9]{1,3}([^0-9]+)[0-9]{1,3}\1[0-9]{1,3}\1[0-9]{1,3}$|^[0-9a-f:]+$",
    "card": r"^[0-9]{4}([ ./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|^[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}$",
    "phone": r"^(?:\+[0-9]{1,3} ?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}$|^00[0-9]{1,2}(?:[ .-][0-9]+)+$|^\+[0-9]{1,3}(?:[ .-][0-9]{2,})+$",
}
#: Characters of context before a span; steps of EM and of the classifier; the least probability of an added span.
BEFORE, STEPS, LEAST = 24, 50, 0.95
LABELERS = ("check", "gazetteer", "context", "against", "shape")
#: Of a span itself; the numbers of digits are 8 and fewer, 9 to 12, 13 to 19, more.
FEATURES = ("sound", "listed", "named", "denied", "shaped", "glued", "spaced", "digits")
#: Rows of the table of patterns, a kind: 3 votes of two labelers, 2 of two, 3 of one; features follow from few more.
PATTERNS = 3 * 2 * 2 * 2 * 3 * 2**7 * 4
_SPAN = "array<struct<start:int,stop:int,found:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches in order: start, stop (code points, end exclusive), found."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    both = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        start = (acc["at"] + x["gap"]).cast("int")
        stop = (start + F.length(x["m"])).cast("int")
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), x["m"].alias("found")))).alias("out"))

    return F.aggregate(both, F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")), step, lambda acc: acc["out"])


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    back = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(back, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), add) % 10 == 0


#: Parts of an address that are at most 255, with leading zeros.
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def passes(kind: str, found: Column) -> Column:
    """The check of a base match."""
    if kind == "ip":
        return found.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits(found)).between(13, 19) & luhn(digits(found))
    if kind == "phone":
        return F.length(digits(found)).between(9, 15)
    return F.lit(True)


def plain_value(kind: str, found: Column) -> Column:
    """A span in lower case, written as its base pattern would have it."""
    low = F.lower(found)
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(low, rf" ?{_AT} ?| at | @ ", "@"), rf" ?{_DOT} ?| dot ", "."), r" ?\. ?", ".")
    if kind == "ip":
        return F.regexp_replace(low, r"\[\.\]|\(\.\)| \. ", ".")
    return low


def sound(kind: str, value: Column) -> Column:
    """Whether a value, as of plain_value, is one of its kind."""
    if kind == "email":
        return value.rlike(r"^[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}$")
    if kind == "ip":
        return passes(kind, value) | value.rlike(r"^(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$")
    return passes(kind, value)


def judged(text: Column, kind: str) -> Callable[[Column], Column]:
    """Of a span: itself, the votes of LABELERS (1, -1, or 0 to abstain) and its FEATURES."""

    def told(s: Column) -> Column:
        yes = lambda c: F.when(c, 1).otherwise(0)
        value = plain_value(kind, s["found"])
        before = F.lower(F.substring(text, F.greatest(s["start"] - BEFORE + 1, F.lit(1)), F.least(s["start"], F.lit(BEFORE))))
        edge = F.concat(F.substring(text, F.greatest(s["start"], F.lit(1)), F.least(s["start"], F.lit(1))), F.lit("|"), F.substring(text, s["stop"] + 1, F.lit(1)))
        good, listed, named, denied = sound(kind, value), value.rlike(KNOWN[kind]), before.rlike(CONTEXT[kind]), before.rlike(AGAINST)
        shaped, glued = F.lower(s["found"]).rlike(SHAPE[kind]), edge.rlike(r"[\p{L}0-9_]")
        n = F.length(digits(value))
        votes = {"check": F.when(good, 1).otherwise(-1), "gazetteer": yes(listed), "context": yes(named), "against": -yes(denied), "shape": F.when(glued, -1).when(shaped, 1).otherwise(0)}
        own = {"sound": yes(good), "listed": yes(listed), "named": yes(named), "denied": yes(denied), "shaped": yes(shaped), "glued": yes(glued), "spaced": yes(s["found"].rlike(r"[ ()\[\]]")), "digits": F.when(n < 9, 0).when(n < 13, 1).when(n < 20, 2).otherwise(3)}
        return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["found"].alias("found"), F.struct(F.lit(kind).alias("kind"), *[v.cast("int").alias(x) for x, v in (votes | own).items()]).alias("told"))

    return told


def with_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base_<kind>, more_<kind>) of docs (doc_id, text): the base spans and candidates of each kind, judged, by start."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    empty = F.array().cast(_SPAN)

    def base_of(kind: str) -> Column:
        return F.filter(F.col(f"all_{kind}"), lambda s: passes(kind, s["found"]))

    rows = rows.select("*", *[F.when(text.rlike(NEEDS[k]), matches(text, BASE[k])).otherwise(empty).alias(f"all_{k}") for k in KINDS])
    rows = rows.select("*", *[base_of(k).alias(f"base_{k}") for k in KINDS])
    apart = lambda s, column: ~F.exists(F.col(column), lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))

    def free(s: Column) -> Column:
        return reduce(lambda out, k: out & apart(s, f"base_{k}"), KINDS, F.lit(True))

    rows = rows.select("*", *[F.when(text.rlike(NEEDS[k]), F.filter(matches(text, LOOSE[k]), free)).otherwise(empty).alias(f"loose_{k}") for k in KINDS])

    def failed(kind: str) -> Column:
        return F.filter(F.col(f"all_{kind}"), lambda s: ~passes(kind, s["found"]) & free(s) & apart(s, f"loose_{kind}"))

    return rows.select(
        "doc_id",
        *[F.transform(F.col(f"base_{k}"), judged(text, k)).alias(f"base_{k}") for k in KINDS],
        *[F.transform(F.concat(F.col(f"loose_{k}"), failed(k)), judged(text, k)).alias(f"more_{k}") for k in KINDS],
    )


def estimate(counts: dict[tuple[int, ...], float], steps: int = STEPS) -> dict[tuple[int, ...], float]:
    """EM on vote patterns: the probability that a span of each pattern is personal data, labelers taken as independent."""
    if not counts:
        return {}
    n = len(next(iter(counts)))
    belief = {v: 1 / (1 + math.exp(-sum(v))) for v in counts}
    for _ in range(steps):
        prior, table = 0.0, {}
        total = sum(counts.values())
        for y in (0, 1):
            mass = [{x: 1.0 for x in (-1, 0, 1)} for _ in range(n)]  # one of each, so that none is impossible
            for v, c in counts.items():
                p = c * (belief[v] if y else 1 - belief[v])
                for k, x in enumerate(v):
                    mass[k][x] += p
                if y:
                    prior += p
            table[y] = [{x: m[x] / sum(m.values()) for x in m} for m in mass]
        share = (prior + 1) / (total + 2)
        for v in counts:
            odds = math.log(share / (1 - share)) + sum(math.log(table[1][k][x] / table[0][k][x]) for k, x in enumerate(v))
            belief[v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return belief


def inputs(told: dict[str, int]) -> tuple[float, ...]:
    """The classifier's inputs from the FEATURES of a span; the number of digits is one of four."""
    return (*[float(told[f]) for f in FEATURES[:-1]], *[float(told["digits"] == k) for k in range(4)], 1.0)


def classifier(rows: list[tuple[tuple[float, ...], float, float]], steps: int = 2000, rate: float = 1.0) -> list[float]:
    """Logistic weights on inputs, by gradient steps, from (inputs, probability, how many)."""
    n, total = len(FEATURES) + 4, sum(c for _, _, c in rows) or 1.0
    w = [0.0] * n
    for _ in range(steps):
        slope = [0.0] * n
        for x, want, c in rows:
            p = _logistic(sum(a * b for a, b in zip(w, x, strict=True)))
            for k, a in enumerate(x):
                slope[k] += c / total * (p - want) * a
        w = [a - rate * (s + 1e-4 * a) for a, s in zip(w, slope, strict=True)]
    return w


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


#: What labelers mean, as some spans of each kind that the estimates begin with, whatever the data hold: votes (in the
#: order of LABELERS), features (in that of FEATURES, digits aside), how many.
EXAMPLES = (
    ((1, 1, 1, 0, 1), (1, 1, 1, 0, 1, 0, 0), 6.0),
    ((1, 0, 1, 0, 1), (1, 0, 1, 0, 1, 0, 0), 6.0),
    ((1, 0, 1, 0, 1), (1, 0, 1, 0, 1, 0, 1), 6.0),
    ((1, 1, 0, 0, 1), (1, 1, 0, 0, 1, 0, 1), 6.0),
    ((1, 0, 0, 0, 1), (1, 0, 0, 0, 1, 0, 0), 6.0),
    ((-1, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0, 0), 6.0),
    ((-1, 0, 1, 0, 0), (0, 0, 1, 0, 0, 0, 0), 3.0),
    ((-1, 0, 0, 0, 1), (0, 0, 0, 0, 1, 0, 0), 6.0),
    ((-1, 1, 0, 0, 1), (0, 1, 0, 0, 1, 0, 1), 6.0),
    ((-1, 1, 0, 0, 0), (0, 1, 0, 0, 0, 0, 1), 3.0),
    ((-1, 0, 0, -1, 1), (0, 0, 0, 1, 1, 0, 0), 6.0),
    ((1, 0, 0, -1, 0), (1, 0, 0, 1, 0, 0, 0), 6.0),
    ((1, 0, 0, -1, -1), (1, 0, 0, 1, 1, 1, 0), 6.0),
    ((-1, 0, 0, 0, -1), (0, 0, 0, 0, 0, 1, 0), 6.0),
)


def train(spans: DataFrame) -> dict[str, list[float]]:
    """Weights of the span classifier of each kind, from the vote and feature patterns of all documents."""
    columns = [f"{c}_{k}" for k in KINDS for c in ("base", "more")]
    some = spans.filter(" or ".join(f"size({c}) > 0" for c in columns))
    cells = F.concat(*[F.transform(F.col(c), lambda s: s["told"]) for c in columns])
    found = some.select(F.explode(cells).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()  # 4 * PATTERNS rows at most
    out = {}
    for kind in KINDS:
        rows = [(tuple(r["t"][x] for x in LABELERS), inputs(r["t"].asDict()), float(r["n"])) for r in found if r["t"]["kind"] == kind]
        for digit in range(4):
            rows += [(v, inputs(dict(zip(FEATURES, (*f, digit), strict=True))), c) for v, f, c in EXAMPLES]
        counts: dict[tuple[int, ...], float] = {}
        for v, _, c in rows:
            counts[v] = counts.get(v, 0.0) + c
        belief = estimate(counts)
        # Patterns weigh by the root of their number, so that the many plain spans don't decide the rare ones.
        out[kind] = classifier([(x, belief[v], math.sqrt(c)) for v, x, c in rows])
    return out


def find_personal_data(docs: DataFrame, least: float = LEAST, known: Callable[[DataFrame], dict[str, list[float]]] = train) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, and arrays base_<kind> and spans_<kind> of (start, stop, found), by start.

    spans_<kind> holds the base spans and the added ones: candidates that pass the check of their kind and that the
    classifier gives least or more. Null counts as empty; texts without
    matches have empty arrays; repeated rows and null ids pass as they are; an empty table gives an empty
    result; other columns are ignored. A text of any length is read whole. Nothing is shuffled but the counts of patterns.
    """
    spans = written(with_spans(docs), "spans")
    weights = known(spans)

    def bare(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["found"].alias("found"))

    def added(kind: str) -> Column:
        w = weights[kind]

        def likely(s: Column) -> Column:
            told = s["told"]
            odds = F.lit(w[-1])
            for name, a in zip(FEATURES[:-1], w, strict=False):
                odds = odds + told[name] * F.lit(a)
            for k in range(4):
                odds = odds + F.when(told["digits"] == k, w[len(FEATURES) - 1 + k]).otherwise(0.0)
            return (told["sound"] == 1) & (F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)) >= least)

        return F.filter(F.col(f"more_{kind}"), likely)

    base = [F.transform(F.col(f"base_{k}"), bare).alias(f"base_{k}") for k in KINDS]
    both = [F.array_sort(F.transform(F.concat(F.col(f"base_{k}"), added(k)), bare)).alias(f"spans_{k}") for k in KINDS]
    return spans.select("doc_id", *base, *both)


def joined(prefix: str) -> Column:
    """kind:start:end of all spans by kind, then start, joined by commas."""

    def named(kind: str) -> Callable[[Column], Column]:
        return lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["stop"].cast("string"))

    parts = [F.transform(F.col(f"{prefix}_{k}"), named(k)) for k in KINDS]
    return F.array_join(F.concat(*parts), ",")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
