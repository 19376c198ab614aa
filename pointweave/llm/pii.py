"""Personal data: propose by pattern, confirm by checksum, weigh by context (operator 9).

Patterns propose spans of five kinds; a validator confirms each (part range,
Luhn, digit count, mod-97); context words near a span raise its score.  E-mail,
ip, card and phone spans that pass their validator always stay; an ``iban``
must also reach ``least`` after its context is weighed.

DataFrame functions only.  Places come from splitting the text by the same
pattern: a match starts where the lengths of the parts and matches before it
end.  The patterns keep the contract's meaning but use possessive repeats and
look-behinds, so that long runs of digits or letters neither overflow the
stack nor take quadratic time.

Defined results: a null text counts as empty and has no span; offsets count
code points, ends are exclusive; rows are independent, so ties, repeated rows,
null ids and empty tables need nothing special; a clashing column named like a
working column is kept by :func:`redact` and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]

_LOCAL = "A-Za-z0-9._%+-"
_PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
}
#: What a text must hold before its kind's pattern is tried.
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+", "iban": ""}

_OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_VALID = {
    "email": "true",
    "ip": f"rlike(m, '^{_OCTET}[.]{_OCTET}[.]{_OCTET}[.]{_OCTET}$')",
    "card": """length(translate(m, '- ', '')) BETWEEN 13 AND 19 AND
      aggregate(sequence(1, length(translate(m, '- ', ''))), 0, (a, i) -> a +
        CASE WHEN i % 2 = 1 THEN ascii(substring(reverse(translate(m, '- ', '')), i, 1)) - 48
             ELSE (ascii(substring(reverse(translate(m, '- ', '')), i, 1)) - 48) * 2
                  - IF(ascii(substring(reverse(translate(m, '- ', '')), i, 1)) > 52, 9, 0) END) % 10 = 0""",
    "phone": "length(translate(m, '+ ().-', '')) BETWEEN 9 AND 15",
    "iban": """aggregate(sequence(1, length(translate(m, ' ', ''))), 0, (a, i) ->
        CASE WHEN ascii(substring(concat(substring(translate(m, ' ', ''), 5), substring(translate(m, ' ', ''), 1, 4)), i, 1)) < 58
             THEN (a * 10 + ascii(substring(concat(substring(translate(m, ' ', ''), 5), substring(translate(m, ' ', ''), 1, 4)), i, 1)) - 48) % 97
             ELSE (a * 100 + ascii(substring(concat(substring(translate(m, ' ', ''), 5), substring(translate(m, ' ', ''), 1, 4)), i, 1)) - 55) % 97 END) = 1""",
}
#: Score of a confirmed span, what context adds, and the words that count.
_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7}
CONTEXT_GAIN, CONTEXT_CHARS, LEAST = 0.2, 40, 0.65
_CONTEXT = {
    "email": "mail|contact|write to",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|payment|debit",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|transfer",
}


def _spans(kind: str, text: str, matches: str, parts: str) -> Column:
    """Confirmed spans of one kind, in order: start, end, kind, score."""
    context = f"rlike(lower(substring({text}, greatest(1, p.s + 1 - {CONTEXT_CHARS}), p.e - p.s + 2 * {CONTEXT_CHARS})), '{_CONTEXT[kind]}')"
    empty = "cast(array() AS array<struct<start:bigint,end:bigint>>)"
    # the running place moves over every match; only confirmed ones are kept
    kept = f"""
      aggregate(zip_with({matches}, slice({parts}, 1, size({matches})), (m, part) -> named_struct('m', m, 'part', part)),
        named_struct('at', 0L, 'spans', {empty}),
        (acc, x) -> named_struct(
          'at', acc.at + length(x.part) + length(x.m),
          'spans', CASE WHEN exists(array(x.m), m -> {_VALID[kind]})
            THEN concat(acc.spans, array(named_struct('start', acc.at + length(x.part), 'end', acc.at + length(x.part) + length(x.m))))
            ELSE acc.spans END),
        acc -> acc.spans)"""
    scored = f"""
      transform({kept}, sp -> element_at(transform(array(named_struct('s', cast(sp.start AS int), 'e', cast(sp.end AS int))), p ->
        named_struct('start', sp.start, 'end', sp.end, 'kind', '{kind}',
          'score', {_SCORE[kind]}D + IF({context}, {CONTEXT_GAIN}D, 0D))), 1))"""
    out = F.expr(scored)
    none = F.expr("cast(array() AS array<struct<start:bigint,end:bigint,kind:string,score:double>>)")
    out = F.when(F.size(matches) > 0, out).otherwise(none)
    return out if kind in BASE else F.filter(out, lambda s: s["score"] >= LEAST)


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one array column of spans per kind, named ``pii_<kind>``."""
    own = [f"pii_{k}" for k in KINDS]
    work = docs.drop(*own).withColumn("pii_text", F.coalesce(F.col(text), F.lit("")))
    work = work.withColumn("pii_digit", F.col("pii_text").rlike("[0-9]"))
    for kind in KINDS:
        tried = F.contains("pii_text", F.lit(_NEEDS[kind])) & (F.lit(True) if kind == "email" else F.col("pii_digit"))
        pattern = F.lit(_PATTERNS[kind])
        work = work.withColumn(f"pii_m_{kind}", F.when(tried, F.regexp_extract_all("pii_text", pattern, F.lit(0))).otherwise(F.array().cast("array<string>")))
    work = work.withColumns({f"pii_p_{k}": F.when(F.size(f"pii_m_{k}") > 0, F.split("pii_text", _PATTERNS[k], -1)) for k in KINDS})
    work = work.withColumns({f"pii_{k}": _spans(k, "pii_text", f"pii_m_{k}", f"pii_p_{k}") for k in KINDS})
    return work.drop("pii_text", "pii_digit", *(f"pii_m_{k}" for k in KINDS), *(f"pii_p_{k}" for k in KINDS))


def _joined(*kinds: str) -> Column:
    every = F.concat(*(F.col(f"pii_{k}") for k in kinds))
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans with their scores."""
    x = with_spans(docs.select("doc_id", "text"))
    every = F.concat(*(F.col(f"pii_{k}") for k in KINDS))
    return x.select(
        "doc_id",
        *(F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(*BASE), 256).alias("base_sha256"),
        _joined(*KINDS).alias("spans"),
        F.array_join(F.transform(every, lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets.

    Overlapping spans become one replacement, named after the first of them.
    A null text stays null.
    """
    own = [f"pii_{k}" for k in KINDS]
    x = with_spans(docs.withColumn("pii_source", F.struct(*docs.columns)).select("pii_source", F.col(text).alias("pii_of")), "pii_of")
    x = x.withColumn("pii_all", F.array_sort(F.concat(*(F.col(c) for c in own))))
    pieces = """
      aggregate(pii_all, named_struct('at', 0L, 'out', cast(array() AS array<string>)),
        (acc, s) -> named_struct('at', greatest(acc.at, s.end), 'out',
          CASE WHEN s.start >= acc.at
            THEN concat(acc.out, array(substring(pii_of, cast(acc.at + 1 AS int), cast(s.start - acc.at AS int)), concat('[', upper(s.kind), ']')))
            ELSE acc.out END),
        acc -> array_join(concat(acc.out, array(substring(pii_of, cast(acc.at + 1 AS int)))), ''))"""
    clean = F.when(F.size("pii_all") > 0, F.expr(pieces)).otherwise(F.col("pii_of"))
    x = x.withColumn("pii_clean", clean)
    return x.select(*(F.col("pii_clean").alias(text) if c == text else F.col("pii_source")[c].alias(c) for c in docs.columns))
