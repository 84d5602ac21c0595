"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust a score.

DataFrame functions only. A pattern's matches come from one pass, the text between them from another; their lengths give
the places in code points. Four base kinds are fixed: every match that passes its check counts. Added kinds are scored:
a pattern's own weight, plus what a check proves and what the match's form tells, plus or less what words within ``NEAR``
characters before or after it say; above ``BAR`` they count. So the same digits count beside "IBAN" and don't beside
"order no.", and a long hexadecimal string counts beside "token" and doesn't beside "commit".

Patterns are written so that a search takes linear time and no recursion on any text: repeats are possessive and a match
can only begin where a run of its characters begins, or where the match before it ended, which changes no match.

Defined results: a null or empty text has no spans; matches of one kind never overlap, those of different kinds may;
a match that fails its check is dropped and what lies inside it is not tried again; repeated rows are judged each; an empty
table gives no rows; a kept column may have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAR = 0.75
NEAR = 40


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    check: Callable[[Column], Column]
    hint: str | None = None  # characters without which no match exists, tested first
    weight: float = 1.0
    proof: float = 0.0  # what a passed check adds
    needed: bool = True  # whether a match that fails its check is out
    form: str | None = None  # a way of writing that adds to the score
    form_weight: float = 0.0
    context: str | None = None  # words nearby that add to the score, and words that take from it
    context_weight: float = 0.0
    against: str | None = None
    against_weight: float = 0.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(number), ""), lambda c, i: (F.when(c == "", 0).otherwise(c.cast("int")) * (1 + i % 2)).cast("int")),
        F.lit(0),
        lambda s, d: s + F.when(d > 9, d - 9).otherwise(d),
    )
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number of letters and digits leaves 1 modulo 97 with its first four characters put last."""
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    rest = F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda s, c: F.when(c.between("0", "9"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
LOCAL = "[A-Za-z0-9._%+-]"

BASE = (
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), "@"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", lambda m: m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"), "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda m: let(digits(m), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(digits(m)).between(9, 15), "+"),
)
#: Words that tell of goods and papers, and of contents' hashes.
GOODS, HASHES = r"(?i)\b(?:order|invoice|tracking|serial|part|item|sku|isbn|ticket)\b", r"(?i)commit|checksum|digest|\bsha-?(?:1|2|256|512)?\b|\bmd5\b|etag|fingerprint"
ADDED = (
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        lambda m: let(F.replace(m, F.lit(" ")), lambda c: F.length(c).between(15, 34) & mod97(c)),
        weight=0.35,
        proof=0.3,
        form=r"^[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2}",
        form_weight=0.2,
        context=r"(?i)iban|account|konto|compte|cuenta|\bbank|\bbanque|\bbanco",
        context_weight=0.3,
        against=GOODS,
        against_weight=0.3,
    ),
    Kind(
        "secret",
        r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,128}(?![A-Za-z0-9])",
        lambda m: m.rlike("[0-9]") & m.rlike("[A-Fa-f]"),
        weight=0.2,
        proof=0.2,
        context=r"(?i)token|secret|passw|credential|\bbearer\b|api.?key|private.?key|access.?key",
        context_weight=0.5,
        against=HASHES,
        against_weight=0.3,
    ),
    Kind(
        "key",
        r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[oprsu]_[A-Za-z0-9]{36,255}+|sk_(?:live|test)_[A-Za-z0-9]{16,99}+|xox[abprs]-[A-Za-z0-9-]{10,99}+|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)(?![A-Za-z0-9])",
        lambda m: m.rlike("[0-9]") | m.startswith("-"),
        weight=0.6,
        proof=0.2,
        context=r"(?i)token|secret|credential|key\b",
        context_weight=0.1,
        against=r"(?i)\bexample|\bplaceholder|\bdummy|\bfake",
        against_weight=0.3,
    ),
    Kind(
        "phone_local",
        r"(?<![A-Za-z0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![A-Za-z0-9-])",
        lambda m: let(digits(m), lambda d: d.rlike("^[2-9][0-9]{2}[2-9]")),
        weight=0.2,
        proof=0.2,
        needed=False,
        form=r"^\(",
        form_weight=0.2,
        context=r"(?i)\b(?:tel|telephone|phone|mobile|cell|fax|call|whatsapp|sms)\b",
        context_weight=0.4,
        against=GOODS,
        against_weight=0.4,
    ),
)


#: What every match of an added kind holds: one search decides whether a text is searched for each of them.
SIGNS = r"[0-9A-Fa-f]{32}|[A-Z]{2}[0-9]{2}|[0-9]{3}[.\x20-][0-9]{4}|AKIA|gh[oprsu]_|sk_|xox[abprs]-|-----BEGIN"


def _running(lengths: Column) -> Column:
    """Exclusive running sums of an array, in about n * sqrt(n) steps: sums of blocks, then sums inside each block."""

    def add(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)

    def over(a: Column) -> Column:
        n = F.size(a)
        step = F.ceil(F.sqrt(n.cast("double"))).cast("int")
        blocks = F.sequence(F.lit(0), F.ceil(n / step).cast("int") - 1)
        return let(
            F.transform(blocks, lambda b: add(F.slice(a, b * step + 1, step))),
            lambda totals: F.flatten(
                F.transform(
                    blocks,
                    lambda b: let(
                        add(F.slice(totals, F.lit(1), b)),
                        lambda base: F.transform(F.sequence(F.lit(0), F.least(step, n - b * step) - 1), lambda i: base + add(F.slice(a, b * step + 1, i))),
                    ),
                )
            ),
        )

    return let(lengths, over)


def scored(kind: Kind, passed: Column, match: Column, said: Column) -> Column:
    """Whether a match of an added kind counts: ``passed`` is its check, ``said`` the text beside it."""
    parts = [(passed, kind.proof), (match.rlike(kind.form or "$^"), kind.form_weight), (said.rlike(kind.context), kind.context_weight), (said.rlike(kind.against), -kind.against_weight)]
    score = F.lit(kind.weight)
    for holds, weight in parts:
        score = score + F.when(holds, weight).otherwise(0.0)
    return (passed | F.lit(not kind.needed)) & (score > BAR)


EMPTY = "array<struct<start:long,kind_no:int,end:long,kind:string>>"


def spans_of(text: Column, kind: Kind, number: int) -> Column:
    """The kind's spans that count, in order: array of (start, kind_no, end, kind)."""
    none = F.array().cast(EMPTY)

    def placed(found: Column) -> Column:
        def beside(gaps: Column, i: Column) -> Column:
            """What stands next to a match, up to ``NEAR`` characters on either side, the matches next to it included."""
            ahead = F.concat(F.when(i > 1, F.concat(F.element_at(gaps, i - 1), F.element_at(found, i - 1))).otherwise(""), F.element_at(gaps, i))
            behind = F.concat(F.element_at(gaps, i + 1), F.coalesce(F.try_element_at(found, i + 1), F.lit("")))
            return F.concat(F.substring(ahead, -NEAR, NEAR), F.lit("\n"), F.substring(behind, 1, NEAR))

        def build(gaps: Column) -> Column:
            steps = F.transform(F.sequence(F.lit(1), F.size(found)), lambda i: (F.length(F.element_at(gaps, i)) + F.length(F.element_at(found, i))).cast("long"))

            def span(i: Column, before: Column) -> Column:
                start = (before + F.length(F.element_at(gaps, i))).cast("long")
                match = F.element_at(found, i)
                good = kind.check(match)
                if kind.context:
                    good = scored(kind, good, match, beside(gaps, i))
                return F.struct(start.alias("start"), F.lit(number).alias("kind_no"), (start + F.length(match)).cast("long").alias("end"), F.lit(kind.name).alias("kind"), good.alias("good"))

            spans = let(_running(steps), lambda before: F.transform(F.sequence(F.lit(1), F.size(found)), lambda i: span(i, F.element_at(before, i))))
            return F.transform(F.filter(spans, lambda s: s["good"]), lambda s: F.struct(s["start"], s["kind_no"], s["end"], s["kind"])).cast(EMPTY)

        return F.when(F.size(found) > 0, let(F.split(text, kind.pattern, -1), build)).otherwise(none)

    held = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), placed)
    return F.when(F.contains(text, F.lit(kind.hint)), held).otherwise(none) if kind.hint else held


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, base_spans and all_spans: arrays of (start, kind_no, end, kind), sorted. No shuffle."""
    held = [f"_k{i}" for i in range(len(keep))]
    text = F.coalesce(F.col("_text"), F.lit(""))
    read = docs.select(*[F.col(c).alias(h) for c, h in zip(keep, held, strict=True)], F.col(text_col).alias("_text"))
    signed, none = F.col("_text").rlike(SIGNS), F.array().cast(EMPTY)
    spans = [F.when(signed, x).otherwise(none) if k in ADDED else x for k, x in ((k, spans_of(text, k, i)) for i, k in enumerate(BASE + ADDED))]
    found = read.select(*held, *[x.alias(f"_{k.name}") for x, k in zip(spans, BASE + ADDED, strict=True)])
    base = F.array_sort(F.concat(*[F.col(f"_{k.name}") for k in BASE]))
    every = F.array_sort(F.concat(*[F.col(f"_{k.name}") for k in BASE + ADDED]))
    return found.select(*[F.col(h).alias(c) for c, h in zip(keep, held, strict=True)], base.alias("base_spans"), every.alias("all_spans"))
