"""Personal data in text: patterns propose spans, checksums confirm them, context words adjust their score.

DataFrame operations only. A pattern's matches and the pieces between them (split) alternate, so running lengths give
every match its place in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Each pattern finds what the plain form finds. Runs are possessive, and a match may only start where a run of its
#: first class starts or where the last match ended (\G), so long runs cost linear time and no deep recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "key": r"(?<![0-9A-Za-z_])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z_])",
    "secret": r"(?<![0-9A-Za-z_])[0-9a-f]{32,64}(?![0-9A-Za-z_])",
}
BASE, ADDED = ("email", "ip", "card", "phone"), ("iban", "ssn", "key", "secret")

#: A kind's score before context in tenths, the words near it that raise the score and those that lower it.
PRIOR = {"email": 9, "ip": 6, "card": 8, "phone": 7, "iban": 7, "ssn": 4, "key": 7, "secret": 4}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "address|server|host|login",
    "card": "card|visa|credit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social security|social-security",
    "key": "aws|access|key|secret",
    "secret": "token|secret|password|passwd|api.?key",
}
DOUBT = {
    "email": "example|noreply|no-reply",
    "ip": "version|release|section",
    "card": "order|serial|isbn|test card",
    "phone": "order|serial|fiction",
    "iban": "sample iban|example",
    "ssn": "order|serial|part no",
    "key": "sample|example|placeholder",
    "secret": "sha1|sha256|md5|checksum|commit|digest",
}
#: Tenths that a word near a span adds or takes, the least that an added span must have, and how many characters are near.
RAISE, LOWER, LEAST, NEAR = 3, 3, 6, 40

#: A text without this character has no match, so the pattern isn't tried.
_NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}

#: Matches that are placed together; the sums before each such run are placed first, so both folds stay short.
_RUN = 256

#: Places of the matches {m} among the pieces {g}: x the match, s and e its bounds, n what is near it up to the next matches.
_PLACED = """flatten(zip_with(
  transform(sequence(0, (size({m}) - 1) div {run}), k -> zip_with(
    zip_with(slice({m}, k * {run} + 1, {run}), slice({g}, k * {run} + 1, least({run}, size({m}) - k * {run})), (x, y) -> named_struct('x', x, 'g', length(y), 'b', right(y, {near}))),
    slice({g}, k * {run} + 2, least({run}, size({m}) - k * {run})),
    (v, y) -> named_struct('x', v.x, 'g', v.g, 'n', lower(concat(v.b, ' ', left(y, {near})))))),
  aggregate(
    transform(sequence(0, (size({m}) - 1) div {run}), k ->
      aggregate(slice({m}, k * {run} + 1, {run}), 0, (t, x) -> t + length(x)) + aggregate(slice({g}, k * {run} + 1, {run}), 0, (t, y) -> t + length(y))),
    array(0), (o, t) -> array_append(o, element_at(o, -1) + t), o -> slice(o, 1, size(o) - 1)),
  (c, o) -> aggregate(c, named_struct('p', o, 'o', cast(array() as array<struct<s:int,e:int,x:string,n:string>>)),
    (a, z) -> named_struct('p', a.p + z.g + length(z.x), 'o', array_append(a.o, named_struct('s', a.p + z.g, 'e', a.p + z.g + length(z.x), 'x', z.x, 'n', z.n))),
    a -> a.o)))"""

_DIGITS = "regexp_replace(v.x, '[^0-9]', '')"

#: Luhn: from the right every second digit counts double, less 9 above 9; the sum divides by 10.
_LUHN = """aggregate(sequence(1, length({d})), 0, (t, i) -> t + (case when i % 2 = 1 then cast(substring({d}, length({d}) - i + 1, 1) as int)
  else 2 * cast(substring({d}, length({d}) - i + 1, 1) as int) - if(substring({d}, length({d}) - i + 1, 1) > '4', 9, 0) end)) % 10 = 0"""

#: Mod-97: the first four characters go to the end, letters count as 10 to 35, the whole leaves 1.
_MOD97 = """aggregate(split(concat(substring({t}, 5), substring({t}, 1, 4)), ''), 0, (r, c) -> case when c = '' then r
  when c < 'A' then (r * 10 + cast(c as int)) % 97 else (r * 100 + ascii(c) - 55) % 97 end) = 1"""

CONFIRM = {
    "email": "true",
    "ip": "forall(split(v.x, '[.]'), o -> length(ltrim('0', o)) <= 3 and coalesce(try_cast(ltrim('0', o) as int), 0) <= 255)",
    "card": f"length({_DIGITS}) between 13 and 19 and {_LUHN.format(d=_DIGITS)}",
    "phone": f"length({_DIGITS}) between 9 and 15",
    "iban": "length(replace(v.x, ' ', '')) between 15 and 34 and " + _MOD97.format(t="replace(v.x, ' ', '')"),
    "ssn": "true",
    "key": "size(array_distinct(split(v.x, ''))) >= 8",
    "secret": "size(array_distinct(split(v.x, ''))) >= 8 and v.x rlike '[0-9]' and v.x rlike '[a-f]'",
}


def _found(kind: str, near: int) -> Column:
    """The confirmed spans of a kind, with their scores, from the columns m_<kind> and g_<kind>."""
    placed = _PLACED.format(m=f"m_{kind}", g=f"g_{kind}", run=_RUN, near=near)
    score = f"{PRIOR[kind]} + if(v.n rlike '{CONTEXT[kind]}', {RAISE}, 0) - if(v.n rlike '{DOUBT[kind]}', {LOWER}, 0)"
    none = "cast(array() as array<struct<kind:string,start:int,end:int,score:int>>)"
    spans = f"transform(filter({placed}, v -> {CONFIRM[kind]}), v -> named_struct('kind', '{kind}', 'start', v.s, 'end', v.e, 'score', {score}))"
    return F.expr(f"if(size(m_{kind}) = 0, {none}, {spans if kind in BASE else f'filter({spans}, v -> v.score >= {LEAST})'})")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR) -> DataFrame:
    """One row per row of ``docs``: doc_id and, for each kind, ``spans_<kind>``: array of (kind, start, end, score).

    Spans of a kind are leftmost and don't overlap, in code points, end exclusive; what a check refuses is dropped
    without another try. Scores are tenths: a kind's prior, more for a word near it that speaks for the kind, less for one
    that speaks against it. Near is ``near`` characters at either side, up to the next match of the kind's pattern.
    Email, ip, card and phone are kept whatever their score. Iban (mod-97), ssn, key (access keys by prefix) and secret
    (hexadecimal runs of 32 to 64, with digits and letters) are added where their score reaches LEAST. Spans of different
    kinds may overlap. Time is in proportion to the text. Nothing is shuffled. Null and empty texts have no spans; a null
    id stays. Rows that repeat are each scanned. Extra columns are ignored. An empty table gives an empty one.
    """
    none = F.expr("cast(array() as array<string>)")
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text_"))
    for kind, pattern in PATTERNS.items():
        m = F.regexp_extract_all("text_", F.lit(pattern), F.lit(0))
        x = x.withColumn(f"m_{kind}", F.when(F.contains("text_", F.lit(_NEEDS[kind])), m).otherwise(none) if kind in _NEEDS else m)
    for kind, pattern in PATTERNS.items():
        x = x.withColumn(f"g_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("text_", pattern)).otherwise(none))
    return x.select("doc_id", *[_found(k, near).alias(f"spans_{k}") for k in PATTERNS])


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts of each base kind and of all spans, the digest of the base spans, all spans as text, and their scores."""
    every = lambda kinds, say: F.array_join(F.concat(*[F.transform(f"spans_{k}", say) for k in kinds]), ",")
    span = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    total = sum((F.size(f"spans_{k}") for k in BASE + ADDED), F.lit(0)).cast("long")
    return found.select(
        "doc_id", *[F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in BASE], F.sha2(every(BASE, span), 256).alias("base_sha256"),
        every(BASE + ADDED, span).alias("spans"), total.alias("n_all"), every(BASE + ADDED, lambda s: s["score"].cast("string")).alias("scores"),
    )


def _sql() -> str:
    """The query's rows in DuckDB: the plain patterns, and places from the pieces between matches.

    A span with nothing of its own class at either side is a whole run of that class, so an ssn, a key or a secret needs
    no look-around there: runs are found and the others dropped before what is near is taken.
    """
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
        "ssn": r"[0-9-]+",
        "key": r"[0-9A-Za-z_]+",
        "secret": r"[0-9A-Za-z_]+",
    }
    whole = {"ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}", "key": "(?:AKIA|ASIA)[0-9A-Z]{16}", "secret": "[0-9a-f]{32,64}"}
    digits = "regexp_replace(v.x, '[^0-9]', '', 'g')"
    one = "substr({d}, length({d}) - j + 1, 1)::INT".format(d=digits)
    bare = "replace(v.x, ' ', '')"
    moved = f"(substr({bare}, 5) || substr({bare}, 1, 4))"
    value = f"CASE WHEN substr({moved}, j, 1) < 'A' THEN try_cast(substr({moved}, j, 1) AS INT) ELSE ascii(substr({moved}, j, 1)) - 55 END"
    varied = "len(list_distinct(string_split(v.x, ''))) >= 8"
    ok = {
        "email": "true",
        "ip": "len(list_filter(string_split(v.x, '.'), lambda o: length(ltrim(o, '0')) > 3 OR coalesce(try_cast(ltrim(o, '0') AS INT), 0) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN {one} ELSE 2 * {one} - CASE WHEN {one} > 4 THEN 9 ELSE 0 END END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"length({bare}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(range(1, length({bare}) + 1), lambda j: {value})), lambda r, c: (CASE WHEN c > 9 THEN r * 100 ELSE r * 10 END + c) % 97) = 1",
        "ssn": "true",
        "key": varied,
        "secret": f"{varied} AND regexp_matches(v.x, '[0-9]') AND regexp_matches(v.x, '[a-f]')",
    }
    parts = []
    for kind, p in plain.items():
        fit = f"regexp_full_match(m[i], '{whole[kind]}')" if kind in whole else "true"
        score = f"{PRIOR[kind]} + CASE WHEN regexp_matches(v.n, '{CONTEXT[kind]}') THEN {RAISE} ELSE 0 END - CASE WHEN regexp_matches(v.n, '{DOUBT[kind]}') THEN {LOWER} ELSE 0 END"
        enough = "true" if kind in BASE else f"{score} >= {LEAST}"
        parts.append(f"""{kind}_m AS (SELECT rid, t, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS g FROM d),
{kind}_s AS (SELECT rid, t, list_transform(list_filter(range(1, len(m) + 1), lambda i: {fit}), lambda i: struct_pack(x := m[i], s := (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT)) AS f FROM {kind}_m),
{kind}_n AS (SELECT rid, list_transform(range(1, len(f) + 1), lambda i: struct_pack(x := f[i].x, s := f[i].s, n := lower(
  substr(t, greatest(f[i].s - {NEAR}, coalesce(f[i-1].s + length(f[i-1].x), 0)) + 1, f[i].s - greatest(f[i].s - {NEAR}, coalesce(f[i-1].s + length(f[i-1].x), 0))) || ' ' ||
  substr(t, f[i].s + length(f[i].x) + 1, least({NEAR}, coalesce(f[i+1].s, length(t)) - f[i].s - length(f[i].x)))))) AS f FROM {kind}_s),
{kind}_f AS (SELECT rid, list_filter(f, lambda v: {ok[kind]} AND {enough}) AS f FROM {kind}_n),
{kind} AS (SELECT rid, list_transform(f, lambda v: '{kind}:' || v.s || ':' || (v.s + length(v.x))) AS {kind}, list_transform(f, lambda v: ({score})::VARCHAR) AS {kind}_score FROM {kind}_f)""")
    joined = lambda kinds, end="": "array_to_string(" + " || ".join(k + end for k in kinds) + ", ',')"
    counts = ", ".join(f"len({k})::BIGINT AS n_{k}" for k in BASE)
    joins = " ".join(f"JOIN {k} USING (rid)" for k in plain)
    total = " + ".join(f"len({k})" for k in plain)
    return "WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents), " + ",\n".join(parts) + (
        f"\nSELECT doc_id, {counts}, sha256({joined(BASE)}) AS base_sha256, {joined(BASE + ADDED)} AS spans, ({total})::BIGINT AS n_all, {joined(BASE + ADDED, '_score')} AS scores FROM d {joins}"
    )


ORACLE = _sql()
