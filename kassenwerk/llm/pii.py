r"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Every step is a built-in function. Offsets are code points: splitting a text by a pattern
gives the pieces between its matches, whose lengths add up to the matches' places.

The patterns are written so that the regular-expression engine neither recurses nor scans
a run twice: a repeated group is possessive where nothing that follows could need its
last round, and a run's later starts are tried only right after a match, because they fail
where its first start fails.

Null texts count as empty and have no spans. Each row stands for itself, so repeated rows,
ties, null ids and further columns need no rule; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kassenwerk.llm.texts import fresh, let

_SPAN = "struct<kind:string,start:int,end:int,score:double>"
_FOUND = "array<struct<start:int,end:int,match:string,near:string>>"
NEAR = 40  # characters of context on either side
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# National lengths of account numbers with a mod-97 checksum.
IBAN_LENGTHS = dict(
    AD=24, AE=23, AT=20, BE=16, BG=22, BH=22, CH=21, CY=28, CZ=24, DE=22, DK=18, EE=20, ES=24,
    FI=18, FR=27, GB=22, GR=27, HR=21, HU=28, IE=22, IL=23, IS=26, IT=27, LI=21, LT=20, LU=20,
    LV=21, MC=27, MT=31, NL=18, NO=15, PL=28, PT=25, RO=24, RS=22, SA=24, SE=24, SI=19, SK=24,
    SM=27, TR=26, UA=29,
)


@dataclass(frozen=True)
class Kind:
    """``hint`` is a cheap test that a text without a match usually fails."""

    name: str
    pattern: str
    hint: str
    score: float
    raised_by: str
    lowered_by: str = ""

    def confirmed(self, match: Column) -> Column:
        return {
            "email": lambda m: F.lit(True),
            "ip": lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
            "card": _card,
            "phone": lambda m: F.length(F.translate(m, "+ ().-", "")).between(9, 15),
            "iban": _iban,
        }[self.name](match)


def _card(match: Column) -> Column:
    digits = F.translate(match, " -", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _iban(match: Column) -> Column:
    """The country's length, and 1 as the remainder by 97 with letters read as 10 to 35."""
    compact = F.translate(match, " ", "")
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    turned = F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda r, c: F.when(c == "", r).otherwise(
            (r * F.when(value(c) > 9, F.lit(100)).otherwise(F.lit(10)) + value(c)) % 97
        ),
    )
    return (F.try_element_at(lengths, F.substring(compact, 1, 2)) == F.length(compact)) & (rest == 1)


BASE_KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@", 0.9, r"\b(?:e-?mail|mail|contact|kontakt|write|correo|courriel)\b",
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]\.[0-9]++\.[0-9]", 0.6, r"\b(?:ip|host|server|address|adresse|login)\b",
        r"\b(?:version|release|section|chapter)\s*$",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        r"[0-9](?:[\x20-]?[0-9]){12}", 0.8, r"\b(?:card|visa|mastercard|credit|karte|carte|tarjeta)\b",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+[0-9]", 0.7, r"\b(?:phone|tel|call|fax|mobile|telefon|appel|llamar)\b",
    ),
)
KINDS = (
    *BASE_KINDS,
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[\x20A-Z0-9]", 0.9, r"\b(?:iban|account|konto|compte|cuenta)\b",
    ),
)


def _proposed(text: Column, pattern: str) -> Column:
    """Matches from left to right with their places and the characters around them."""

    def placed(pieces: Column, matches: Column) -> Column:
        near = lambda i: F.lower(F.concat_ws(" ", F.right(F.get(pieces, i), F.lit(NEAR)), F.left(F.get(pieces, i + 1), F.lit(NEAR))))
        rows = F.transform(
            matches,
            lambda m, i: F.struct(m.alias("match"), F.length(F.get(pieces, i)).alias("gap"), near(i).alias("near")),
        )

        def add(seen: Column, x: Column) -> Column:
            start = seen["at"] + x["gap"]
            end = start + F.length(x["match"])
            found = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), x["near"].alias("near"))
            return F.struct(end.alias("at"), F.concat(seen["out"], F.array(found)).alias("out"))

        none = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))
        return F.aggregate(rows, none, add, lambda seen: seen["out"])

    return let(
        F.split(text, pattern, -1),
        lambda pieces: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: placed(pieces, m)),
    )


def spans_of(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind, by start."""
    body = F.coalesce(text, F.lit(""))
    raised = F.when(F.lit(kind.raised_by != ""), F.lit(0.1))
    hinted = body.contains(kind.hint) if kind.hint == "@" else body.rlike(kind.hint)

    def scored(x: Column) -> Column:
        score = F.lit(kind.score) + F.when(x["near"].rlike(kind.raised_by), raised).otherwise(F.lit(0.0))
        if kind.lowered_by:
            score = score - F.when(x["near"].rlike(kind.lowered_by), F.lit(0.3)).otherwise(F.lit(0.0))
        return F.struct(
            F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score.alias("score")
        )

    found = F.filter(_proposed(body, kind.pattern), lambda x: kind.confirmed(x["match"]))
    return F.when(hinted, F.transform(found, scored)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def find(df: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``df`` with ``pii_spans``: all spans by kind as listed, then start."""
    every = F.concat(*[spans_of(F.col(text), k) for k in kinds])
    return df.withColumn("pii_spans", every)


def span_text(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(df: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """``df`` with each span of at least that score replaced by its kind in brackets.

    Overlapping spans are replaced as one, named after the first. Null texts stay null.
    """
    body, found = F.col(text), fresh(df, "_pii_spans")

    def masked(spans: Column) -> Column:
        def add(seen: Column, s: Column) -> Column:
            apart = s["start"] >= seen["at"]
            more = F.array(
                F.substring(body, seen["at"] + 1, s["start"] - seen["at"]),
                F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")),
            )
            return F.struct(
                F.greatest(seen["at"], s["end"]).alias("at"),
                F.when(apart, F.concat(seen["out"], more)).otherwise(seen["out"]).alias("out"),
            )

        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(
            spans,
            none,
            add,
            lambda seen: F.concat(F.array_join(seen["out"], ""), F.substring(body, seen["at"] + 1, F.length(body))),
        )

    strong = F.filter(F.col(found), lambda s: s["score"] >= least)
    by_start = F.sort_array(
        F.transform(strong, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    every = F.concat(*[spans_of(body, k) for k in KINDS])
    return (
        df.withColumn(found, every)
        .withColumn(text, F.when(F.size(found) > 0, let(by_start, masked)).otherwise(body))
        .drop(found)
    )
