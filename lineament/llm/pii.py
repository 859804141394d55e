"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Values are found by one pattern, validated, and permuted within their format:

* e-mail addresses: the local part, letter for letter and digit for digit;
* phone numbers of 8 to 15 digits after "+": the digits after the country code;
  NNN-NNN-NNNN, NNN.NNN.NNNN and (NNN) NNN-NNNN from area 200: among these;
* card numbers of 13 to 19 digits, together or in the usual groups, whose Luhn
  check digit is right: all digits but the last, which is made right again;
* numbers NNN-NN-NNNN in the assigned ranges (area 001 to 899 but not 666, group
  and serial not zero): within these ranges;
* IPv4 addresses: the 32 bits, in two halves of 16;
* IBANs, together or in groups of four, whose remainder by 97 is right: the account,
  digit for digit and letter for letter; the check digits are made right again;
* dates YYYY-MM-DD, YYYY/MM/DD and DD.MM.YYYY from 1800 to 2199: the day among the
  146,097 of the cycle, the same in every layout.

Letters are permuted among a to z, A to Z, the small and the great ones of Latin-1,
Latin Extended-A and Cyrillic; others in a local part stay.
Each is a permutation under the key and the kind, so equal values get equal
pseudonyms in every document and different ones differ. What only looks like a
value (a wrong check digit, an unassigned range, no such day) stays as it is and
is not counted; no pseudonym falls among what stays. All of it is native expressions.

The key comes from the caller. Spark shows plans with their constants: where these are
kept, set spark.sql.redaction.string.regex so that it hides the key.

A null text stays null, an empty one empty. Very long texts are replaced whole.
Repeated rows and several values in a row are each replaced. An empty table gives no
rows. Kept columns stay; a made one of the same name gets an underscore before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free, named, table

ROUNDS = 8
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}+",
    "phone": r"(?<![0-9])\+[0-9]{1,3} ?\([0-9]{3}\) ?[0-9]{3}[- ][0-9]{4}(?![0-9])"
    r"|(?<![0-9A-Za-z_+])\+[1-9][0-9]{0,2}[ .-][0-9](?:[ .-][0-9]{2}){4}(?![0-9])"
    r"|(?<![0-9A-Za-z_+])\+[1-9][0-9]{0,2}[ .-]\(?[0-9]{1,4}\)?[ .-][0-9]{3,4}(?:[ .-][0-9]{3,4})?(?![0-9])"
    r"|(?<![0-9A-Za-z_+])\+[1-9][0-9]{7,14}(?![0-9])"
    r"|(?<![0-9A-Za-z_.+-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9A-Za-z_]|[-.][0-9])",
    "ip": rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9/])[0-9]{4}/[0-9]{2}/[0-9]{2}(?![0-9/])|(?<![0-9.])[0-9]{2}[.][0-9]{2}[.][0-9]{4}(?![0-9]|[.][0-9])",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "number": r"(?<![A-Za-z0-9_])[0-9]{13,19}(?![A-Za-z0-9_])"
    r"|(?<![A-Za-z0-9_-])[0-9]{4}(?:(?: [0-9]{4}){3}(?: [0-9]{3})?|(?:-[0-9]{4}){3}(?:-[0-9]{3})?|[ -][0-9]{6}[ -][0-9]{5})(?![A-Za-z0-9_]|-[0-9])",
}
PATTERNS["iban"] = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ANY = "|".join(PATTERNS.values())
KINDS = tuple(PATTERNS)


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number_mix(key: str, kind: str, r: str, half: str, x: str) -> str:
    """A keyed number below 2^52 from one half of a value."""
    return f"CAST(conv(substring(sha2(concat({quoted(key + '/' + kind + '/')}, {r}, {quoted('/' + half + '/')}, {x}), 256), 1, 13), 16, 10) AS BIGINT)"


def two_halves(key: str, kind: str, a: str, b: str, size_a: int, size_b: int) -> str:
    """Struct of (a, b) permuted: each round adds a mix of one half to the other."""
    one = f"pmod(s.a + {number_mix(key, kind, 'r', 'a', 's.b')}, {size_a})"
    other = f"pmod(s.b + {number_mix(key, kind, 'r', 'b', 's.a')}, {size_b})"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', CAST({a} AS BIGINT), 'b', CAST({b} AS BIGINT)), "
        f"(s, r) -> IF(r % 2 = 1, named_struct('a', {one}, 'b', s.b), named_struct('a', s.a, 'b', {other})))"
    )


#: Letters and digits by the code of the first, and how many follow; code 247 and 215 are signs.
CLASSES = ((97, 26), (65, 26), (48, 10), (224, 31), (192, 31), (256, 128), (1024, 128))
#: Places that one digest of the key stream serves.
STREAM = 16


def shifted(s: str, mix: str) -> str:
    """Each letter and digit of ``s`` moved within its class by four hex digits of a stream of digests of ``mix``."""
    stream = f"array_join(transform(sequence(0, int(length({s}) / {STREAM})), n -> sha2(concat({mix}, '/', n), 256)), '')"
    k = "int(conv(substring(z, 4 * i - 3, 4), 16, 10))"
    c = f"ascii(substring({s}, i, 1))"

    def move(first: int, size: int) -> str:
        skip = {224: 23, 192: 23}.get(first)
        if skip is None:
            code = f"{first} + pmod({c} - {first} + {k}, {size})"
        else:
            place = f"pmod({c} - {first} - IF({c} - {first} > {skip}, 1, 0) + {k}, {size - 1})"
            code = f"{first} + {place} + IF({place} >= {skip}, 1, 0)"
        return f"char({code})" if first < 256 else f"decode(unhex(lpad(hex({code}), 4, '0')), 'UTF-16BE')"

    cases = " ".join(f"WHEN {c} BETWEEN {f} AND {f + n - 1}{f' AND {c} <> {f + 23}' if f in (224, 192) else ''} THEN {move(f, n)}" for f, n in CLASSES)
    each = f"transform(IF(length({s}) > 0, sequence(1, length({s})), CAST(array() AS array<int>)), i -> CASE {cases} ELSE substring({s}, i, 1) END)"
    return f"transform(array({stream}), z -> array_join({each}, ''))[0]"


def characters(key: str, kind: str, s: str) -> str:
    """``s`` with its letters and digits permuted; the halves are the string's."""
    cut = f"CAST(length({s}) / 2 AS INT)"

    def mix(half: str, x: str) -> str:
        return f"concat({quoted(key + '/' + kind + '/')}, r, {quoted('/' + half + '/')}, length(s.a) + length(s.b), '/', {x})"

    one, other = shifted("s.a", mix("a", "s.b")), shifted("s.b", mix("b", "s.a"))
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', substring({s}, 1, {cut}), 'b', substring({s}, {cut} + 1)), "
        f"(s, r) -> IF(r % 2 = 1, named_struct('a', {one}, 'b', s.b), named_struct('a', s.a, 'b', {other})), s -> concat(s.a, s.b))"
    )


def check_digit(s: str) -> str:
    """Luhn check digit for the payload ``s``."""
    return (
        f"pmod(10 - pmod(aggregate(sequence(1, length({s})), 0, (t, i) -> t + "
        f"IF(i % 2 = 1, int(2 * int(substring({s}, -i, 1)) / 10) + pmod(2 * int(substring({s}, -i, 1)), 10), int(substring({s}, -i, 1)))), 10), 10)"
    )


def remainder(s: str) -> str:
    """The number that ``s`` spells, letters as 10 to 35, modulo 97."""
    c = f"substring({s}, i, 1)"
    return f"aggregate(sequence(1, length({s})), 0, (t, i) -> IF({c} BETWEEN '0' AND '9', (10 * t + int({c})) % 97, (100 * t + ascii({c}) - 55) % 97))"


def iso(m: str) -> str:
    """A date of any layout as YYYY-MM-DD."""
    return f"IF(instr({m}, '.') > 0, concat(substring({m}, 7, 4), '-', substring({m}, 4, 2), '-', substring({m}, 1, 2)), replace({m}, '/', '-'))"


def digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def laid(m: str, d: str, filled: str = "0-9") -> str:
    """The digits ``d`` (or what is ``filled``) in the layout of ``m``."""
    place = f"length(regexp_replace(substring({m}, 1, j), '[^{filled}]', ''))"
    return f"array_join(transform(sequence(1, length({m})), j -> IF(substring({m}, j, 1) RLIKE '[{filled}]', substring({d}, {place}, 1), substring({m}, j, 1))), '')"


def valid(m: str) -> str:
    """True if the match is a value of its kind."""
    part = lambda i: f"int(split({m}, '-')[{i}])"
    d = digits(m)
    return (
        f"CASE {kind_of(m)} WHEN 'phone' THEN length({d}) BETWEEN 8 AND 15 "
        f"WHEN 'date' THEN coalesce(datediff(try_cast({iso(m)} AS DATE), DATE'1800-01-01') BETWEEN 0 AND 146096, false) "
        f"WHEN 'iban' THEN exists(array(replace({m}, ' ', '')), v -> length(v) BETWEEN 15 AND 34 AND {remainder('concat(substring(v, 5), substring(v, 1, 4))')} = 1) "
        f"WHEN 'national' THEN {part(0)} BETWEEN 1 AND 899 AND {part(0)} <> 666 AND {part(1)} > 0 AND {part(2)} > 0 "
        f"WHEN 'number' THEN exists(array({d}), d -> {check_digit('substring(d, 1, length(d) - 1)')} = int(substring(d, -1, 1))) ELSE true END"
    )


def pseudonym(key: str, m: str = "m") -> str:
    """The pseudonym of one match."""
    days = f"datediff(try_cast({iso(m)} AS DATE), DATE'1800-01-01')"
    layout = f"CASE WHEN instr({m}, '/') > 0 THEN 'yyyy/MM/dd' WHEN instr({m}, '.') > 0 THEN 'dd.MM.yyyy' ELSE 'yyyy-MM-dd' END"
    date = f"transform(array({two_halves(key, 'date', f'int({days} / 5411)', f'{days} % 5411', 27, 5411)}), d -> date_format(date_add(DATE'1800-01-01', int(d.a * 5411 + d.b)), {layout}))[0]"
    octet = lambda i: f"int(split({m}, '[.]')[{i}])"
    halves = two_halves(key, "ip", f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", 65536, 65536)
    address = f"transform(array({halves}), d -> concat_ws('.', int(d.a / 256), int(d.a % 256), int(d.b / 256), int(d.b % 256)))[0]"
    payload = f"substring({digits(m)}, 1, length({digits(m)}) - 1)"
    number = f"transform(transform(array({characters(key, 'number', payload)}), p -> concat(p, {check_digit('p')})), d -> {laid(m, 'd')})[0]"
    part = lambda i: f"int(split({m}, '-')[{i}])"
    # Areas 1 to 899 without 666 are 898, each with 99 groups of 9,999 serials.
    place = f"({part(0)} - 1 - IF({part(0)} > 666, 1, 0)) * 99 + {part(1)} - 1"
    national = (
        f"transform(array({two_halves(key, 'national', place, f'{part(2)} - 1', 898 * 99, 9999)}), d -> concat_ws('-', "
        f"lpad(string(int(d.a / 99) + 1 + IF(int(d.a / 99) >= 665, 1, 0)), 3, '0'), lpad(string(d.a % 99 + 1), 2, '0'), lpad(string(d.b + 1), 4, '0')))[0]"
    )
    account = characters(key, "iban", "substring(v, 5)")
    checked = f"concat(substring(v, 1, 2), lpad(string(98 - {remainder("concat(p, substring(v, 1, 2), '00')")}), 2, '0'), p)"
    iban = f"transform(transform(array(replace({m}, ' ', '')), v -> transform(array({account}), p -> {checked})[0]), d -> {laid(m, 'd', 'A-Z0-9')})[0]"
    local = (
        f"transform(transform(array({two_halves(key, 'local', f'int(substring({digits(m)}, 1, 3)) - 200', f'int(substring({digits(m)}, 4))', 800, 10**7)}), "
        f"d -> concat(string(d.a + 200), lpad(string(d.b), 7, '0'))), d -> {laid(m, 'd')})[0]"
    )
    code = f"regexp_extract({m}, '^[+][0-9]{{1,3}}', 0)"
    phone = f"concat({code}, {characters(key, 'phone', f'substring({m}, length({code}) + 1)')})"
    email = f"concat({characters(key, 'email', f'substring_index({m}, {quoted('@')}, 1)')}, '@', substring_index({m}, '@', -1))"
    return (
        f"CASE WHEN NOT {valid(m)} THEN {m} ELSE CASE {kind_of(m)} WHEN 'email' THEN {email} "
        f"WHEN 'phone' THEN IF(startswith({m}, '+'), {phone}, {local}) WHEN 'ip' THEN {address} "
        f"WHEN 'date' THEN {date} WHEN 'iban' THEN {iban} WHEN 'national' THEN {national} ELSE {number} END END"
    )


def kind_of(m: str) -> str:
    return (
        f"CASE WHEN instr({m}, '@') > 0 THEN 'email' WHEN {m} RLIKE '^[A-Z]' THEN 'iban' "
        f"WHEN {m} RLIKE '^[+(]|^[0-9]{{3}}[-.][0-9]{{3}}[-.][0-9]{{4}}$' THEN 'phone' "
        f"WHEN {m} RLIKE '^[0-9]{{4}}[-/][0-9]{{2}}[-/][0-9]{{2}}$|^[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}$' THEN 'date' "
        f"WHEN instr({m}, '.') > 0 THEN 'ip' WHEN substring({m}, 4, 1) = '-' THEN 'national' ELSE 'number' END"
    )


def pseudonymised(df: DataFrame, keep: list[str], key: str, text: str = "text", out: str = "text") -> DataFrame:
    """``keep``, the text with pseudonyms, and n_<kind> for each kind of value.

    Texts without a digit and without "@" cannot match and skip the pattern.
    """
    may = named(text).rlike("[0-9][0-9-][0-9-]|@|[0-9][.][0-9]|[+][0-9]|[0-9] [0-9]|[A-Z][0-9]")
    found = F.when(may, F.regexp_extract_all(named(text), F.lit(ANY), F.lit(0)))
    kept = [f"k{i}" for i in range(len(keep))]
    rows = df.select(*[named(c).alias(k) for c, k in zip(keep, kept)], named(text).alias("t"), found.alias("m"))
    new = F.expr(f"transform(m, m -> {pseudonym(key)})")
    glued = F.array_join(F.zip_with(F.split("t", ANY, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    made = rows.select(
        *kept,
        F.when(F.size("m") > 0, glued).otherwise(F.col("t")),
        *[F.coalesce(F.expr(f"size(filter(m, m -> {kind_of('m')} = '{k}' AND {valid('m')}))"), F.lit(0)).cast("long") for k in KINDS],
    )
    return made.toDF(*keep, *free(keep, [out, *(f"n_{k}" for k in KINDS)]))


#: Where a session names the key, and the one that stands in for it in tests.
KEY_SETTING, KEY = "spark.lineament.pseudonym.key", "lineament-demo-key"


def op4(spark, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents"), ["doc_id"], spark.conf.get(KEY_SETTING, KEY))
