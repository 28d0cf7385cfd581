"""Personal data: patterns propose spans, checksums confirm them, context adjusts a score.

Native: DataFrame functions only.  Offsets come from splitting the text at the
matches and adding up the lengths of pieces and matches, in one fold per kind.
The patterns are written so that a long run of letters or digits is scanned once
(possessive loops, and no start inside a run that has failed as a whole).

Base kinds are confirmed by their form alone: ``email``; ``ip`` (parts to 255);
``card`` (16 to 19 digits, Luhn); ``phone`` (8 to 15 digits after a plus).  The
method adds ``iban`` (mod 97), ``short_card`` (13 to 15 digits, Luhn, context),
``national_id`` and ``local_phone`` (context), and ``secret`` (a run of 20 or more
letters and digits, both, near a word such as token, key or password).  A span's score starts at its kind's
prior and gains from context words in the ``BEFORE`` characters before it or the
``AFTER`` behind it, across other matches; added kinds need ``THRESHOLD``, and never
overlap a base span.

Cases: null text counts as empty and has no spans; offsets are code points, end
exclusive; repeated rows each return a row; an empty table gives no rows; only the
text and the id are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
BEFORE, AFTER = 48, 24
#: Matches are folded in blocks of this many, so that appending stays cheap in texts with very many.
BLOCK = 256
_SPAN = "array<struct<start:int,end:int,score:double>>"
_LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheap test that a text must pass to hold the kind at all.
    needs: str
    prior: float
    context: str
    base: bool = True


KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "e-?mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.7, "ip|host|server|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}", 0.8, "card|visa|credit|carte|karte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, "phone|call|tel|fax|mobile"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", 0.9, "iban|account|bank|konto|compte|cuenta", False),
    Kind("short_card", r"(?<![0-9+.-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])", r"[0-9](?:[\x20-]?[0-9]){12}", 0.35, "card|visa|credit|amex|carte|karte|tarjeta", False),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, "ssn|social|security|insurance|passport|identity", False),
    Kind("secret", r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+", r"[A-Za-z0-9]{20}", 0.3, r"\w*(?:token|secret|passw|credential)|\w*key\b|auth|bearer", False),
    Kind("local_phone", r"(?<![0-9+(.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])", r"[0-9][\x20.-][0-9]{3}", 0.25, "phone|call|tel|fax|mobile", False),
)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of the value pass the Luhn test."""
    d = F.reverse(digits(value))
    doubled = F.transform(F.split(d, ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number's check digits hold (remainder 1)."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    step = lambda a, x: F.when(x.rlike("[0-9]"), (a * 10 + F.ascii(x) - 48) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def valid(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind in ("card", "short_card"):
        low, high = (16, 19) if kind == "card" else (13, 15)
        return F.when(n.between(low, high), luhn(value)).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    if kind == "iban":
        return F.when(F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34), mod97(value)).otherwise(False)
    return F.lit(True)


def spans(text: Column, kind: Kind) -> Column:
    """Array of (start, end, score) of the confirmed matches, in order."""
    pieces = F.split(text, kind.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    # A match has two characters at least, so this many pairs hold what lies behind one.
    pair = lambda x: F.left(F.concat(x["piece"], F.coalesce(x["match"], F.lit(""))), F.lit(AFTER))
    behind = lambda pairs: F.transform(pairs, lambda _, i: F.left(F.array_join(F.slice(pairs, i + 2, AFTER // 2), ""), F.lit(AFTER)))
    after = F.transform(F.array(F.transform(F.arrays_zip(pieces.alias("piece"), found.alias("match")), pair)), behind)[0]
    near = rf"\b(?:{kind.context})"

    def fold(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["piece"])
        end = start + F.length(F.coalesce(x["match"], F.lit("")))
        before = F.right(F.concat(state["seen"], x["piece"]), F.lit(BEFORE))
        hit = F.lower(before).rlike(near) | F.lower(x["next"]).rlike(near)
        score = F.lit(kind.prior) + F.when(hit, (1 - kind.prior) / 2 if kind.base else 0.45).otherwise(0.0)
        good = valid(kind.name, x["match"])
        if not kind.base:
            good = good & (score >= THRESHOLD)
        span = F.struct(start.alias("start"), end.alias("end"), score.alias("score"))
        seen = F.right(F.concat(before, F.coalesce(x["match"], F.lit(""))), F.lit(BEFORE))
        return F.struct(end.alias("at"), seen.alias("seen"), F.when(x["match"].isNotNull() & good, F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"))

    zipped = F.arrays_zip(pieces.alias("piece"), found.alias("match"), after.alias("next"))
    start = lambda at, seen, kind: F.struct(at.alias("at"), seen.alias("seen"), F.array().cast(kind).alias("out"))

    def block(state: Column, part: Column) -> Column:
        inner = F.aggregate(part, start(state["at"], state["seen"], _SPAN), fold, lambda x: x)
        return F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), x["seen"].alias("seen"), F.array_append(state["out"], x["out"]).alias("out")))[0]

    blocks = lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), lambda i: F.slice(z, i * BLOCK + 1, F.lit(BLOCK)))
    parts = F.transform(F.array(zipped), blocks)[0]
    folded = F.aggregate(parts, start(F.lit(0), F.lit(""), f"array<{_SPAN}>"), block, lambda state: F.flatten(state["out"]))
    return F.when(text.contains("@") if kind.needs == "@" else text.rlike(kind.needs), folded).otherwise(F.array().cast(_SPAN))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and, for each kind, an array column of its spans."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    # Digits are rare: one look spares most texts all other kinds.
    digit = F.col("__text").rlike("[0-9]")
    rows = rows.select("doc_id", *[(spans(F.col("__text"), k) if k.name == "email" else F.when(digit, spans(F.col("__text"), k)).otherwise(F.array().cast(_SPAN))).alias(k.name) for k in KINDS])
    base = F.concat(*[F.col(k.name) for k in KINDS if k.base])
    apart = lambda a: ~F.exists(base, lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"]))
    return rows.withColumns({k.name: F.filter(k.name, apart) for k in KINDS if not k.base})


def described(kinds: tuple[Kind, ...]) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    text = lambda name: lambda x: F.concat(F.lit(f"{name}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))
    each = [F.transform(k.name, text(k.name)) for k in kinds]
    return F.array_join(F.concat(*each), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base kinds that need no checksum replaced by their names in angle brackets."""
    text = F.col(text_col)
    for k in KINDS:
        if k.name in ("email", "phone"):
            text = F.regexp_replace(text, k.pattern, f"<{k.name}>")
    return docs.withColumn(text_col, text)
