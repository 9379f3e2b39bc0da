"""Personal data: format-preserving Feistel pseudonyms, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

ROUNDS = 10
#: Key of the registered query. A deployment passes its own, kept outside the code.
KEY = "tripleforge-demo-key"

_ALONE = r"(?<![0-9A-Za-z])"
#: Kinds of private values in the order in which they are tried at a place.
PATTERNS = {
    "secret": r"(?i:\b(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key)\b\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9+/_\-]{8,}",
    "access_key": r"\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9]{20,}\b",
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "date": _ALONE + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./-])[0-9]{2}\1[0-9]{4})(?![0-9A-Za-z])",
    "ssn": _ALONE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "card": _ALONE + r"(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\3[0-9]{5})(?![0-9A-Za-z])",
}
#: Whatever a pattern matches holds one of these.
PREFILTER = r"[0-9@]|AKIA|gh[pousr]_|sk-|(?i:token|passw|pwd|secret|key)"
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bind(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def feistel(left: str, right: str, a: str, b: str, key: str, kind: str, reverse: bool = False, hex_digits: str = "13") -> str:
    """SQL struct (l, r): (left, right) of Z_a x Z_b under a keyed permutation: ROUNDS alternating additions
    of a keyed hash of the other half, of so many hex digits (15 at most). ``reverse`` undoes it."""
    mix = lambda half: f"cast(conv(substr(sha2(cast(concat_ws('|', {_q(key)}, {_q(kind)}, i, {half}) as binary), 256), 1, {hex_digits}), 16, 10) as bigint)"
    sign, steps = ("-", f"sequence({ROUNDS - 1}, 0)") if reverse else ("+", f"sequence(0, {ROUNDS - 1})")
    return f"""aggregate({steps}, named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> if(i % 2 = 0,
        named_struct('l', pmod(s.l {sign} {mix('s.r')} % cast({a} as bigint), cast({a} as bigint)), 'r', s.r),
        named_struct('l', s.l, 'r', pmod(s.r {sign} {mix('s.l')} % cast({b} as bigint), cast({b} as bigint)))))"""


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def _permuted_digits(d: str, key: str, kind: str, reverse: bool) -> str:
    """SQL: a string of up to 30 digits under the permutation of all strings of its length (one digit: as it is)."""
    h = f"(length({d}) div 2)"
    ten = lambda n: f"cast(rpad('1', 1 + {n}, '0') as bigint)"
    body = _bind("f", feistel(f"substr({d}, 1, {h})", f"substr({d}, {h} + 1)", ten(h), ten(f"(length({d}) - {h})"), key, kind, reverse, f"if(length({d}) > 26, 15, 13)"), f"concat(lpad(f.l, {h}, '0'), lpad(f.r, length({d}) - {h}, '0'))")
    return f"if(length({d}) < 2, {d}, {body})"


def _filled(mask: str, digits: str) -> str:
    """SQL: ``mask`` with its digits replaced by ``digits`` in order, so separators stay."""
    return f"""aggregate(sequence(1, length({mask})), named_struct('k', 1, 'o', ''), (s, i) -> if(substr({mask}, i, 1) rlike '[0-9]',
        named_struct('k', s.k + 1, 'o', concat(s.o, substr({digits}, s.k, 1))), named_struct('k', s.k, 'o', concat(s.o, substr({mask}, i, 1)))), s -> s.o)"""


def _luhn_sum(d: str, odd: int) -> str:
    """SQL: Luhn sum of the digits, those at ``odd`` places from the right (0: the last) doubled."""
    digit = f"cast(substr({d}, length({d}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (t, i) -> t + if(i % 2 = {odd}, if({digit} > 4, 2 * {digit} - 9, 2 * {digit}), {digit}))"


def _mod97(text: str) -> str:
    """SQL: the number that letters (A = 10) and digits spell, modulo 97."""
    c = f"substr({text}, i, 1)"
    return f"aggregate(sequence(1, length({text})), 0, (t, i) -> if({c} rlike '[0-9]', (t * 10 + cast({c} as int)) % 97, (t * 100 + ascii({c}) - 55) % 97))"


def _date(v: str) -> tuple[str, str]:
    """SQL: (date, format) of a valid date; day before month where both readings are valid, so a month stands first (formats with
    ``MM/`` or ``MM-`` before the day) only where the day is above 12."""
    formats = "transform(array('yyyy-MM-dd', 'dd/MM/yyyy', 'MM/dd/yyyy', 'dd.MM.yyyy', 'dd-MM-yyyy', 'MM-dd-yyyy'), m -> named_struct('d', cast(try_to_timestamp({v}, m) as date), 'm', m))"
    return f"filter({formats.format(v=v)}, x -> x.d >= date'1900-01-01' and if(left(x.m, 2) = 'MM', x.d < date'2100-08-01' and day(x.d) > 12, x.d < date'2100-05-02') and date_format(x.d, x.m) = {v})"


def _date_number(d: str) -> str:
    """SQL: number of a date among all from 1900-01-01 on."""
    return f"datediff({d}, date'1900-01-01')"


def _late_days(month: str) -> str:
    """SQL: number of dates with a day above 12 in the months before ``month`` (0: 1900-01)."""
    return f"({_date_number(f"add_months(date'1900-01-01', cast({month} as int))")} - 12 * {month})"


def _permuted_date(d: str, key: str, reverse: bool) -> str:
    """SQL: date that replaces ``d`` in a notation with the day first or the year first: any of 271 * 270 days."""
    n = _date_number(d)
    return _bind("f", feistel(f"{n} div 270", f"{n} % 270", "271", "270", key, "date", reverse), "date_add(date'1900-01-01', cast(f.l * 270 + f.r as int))")


def _permuted_late_date(d: str, key: str, reverse: bool) -> str:
    """SQL: date that replaces ``d`` in a notation with the month first: one of the 199 * 223 dates with a day above 12, so that it is
    read month first again. On average a month has 18.4368 of them."""
    month = f"cast((year({d}) - 1900) * 12 + month({d}) - 1 as int)"
    n = _bind("m", month, f"{_late_days('m')} + day({d}) - 13")
    back = _bind("g", "cast(f.l * 223 + f.r as int)", _bind("m", f"filter(transform(sequence(-2, 2), k -> cast(floor(g / 18.4368) as int) + k), k -> k >= 0 and {_late_days('k')} <= g and g < {_late_days('(k + 1)')})[0]", f"date_add(add_months(date'1900-01-01', m), g - {_late_days('m')} + 12)"))
    return _bind("n", n, _bind("f", feistel("n div 223", "n % 223", "199", "223", key, "late date", reverse), back))


def replacement(key: str, reverse: bool = False) -> str:
    """SQL struct (kind, new) for a matched value ``v``; null if its validation fails."""
    sha = lambda x, kind: f"sha2(cast(concat_ws('|', {_q(key)}, {_q(kind)}, {x}) as binary), 256)"
    out = lambda kind, new: f"named_struct('kind', {_q(kind)}, 'new', {new})"
    secret_at = r"'[A-Za-z0-9+/_\\-]{8,}$'"
    secret = _bind("x", f"regexp_extract(v, {secret_at}, 0)", f"concat(substr(v, 1, length(v) - length(x)), rpad(substr({sha('x', 'secret')}, 1, length(x)), length(x), '0'))")
    access = f"concat(regexp_extract(v, '^(AKIA|gh._|sk-)', 1), substr(upper({sha('v', 'access_key')}), 1, least(length(v) - length(regexp_extract(v, '^(AKIA|gh._|sk-)', 1)), 64)))"
    email = f"concat('u', substr({sha('lower(v)', 'email')}, 1, 24), '@mail.invalid')"
    octets = "transform(split(v, '[.]'), x -> cast(x as int))"
    ip = _bind("o", octets, _bind("f", feistel("o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536", "65536", key, "ip", reverse), "concat_ws('.', f.l div 256, f.l % 256, f.r div 256, f.r % 256)"))
    date = _bind("d", _date("v"), "if(size(d) = 0, null, " + _bind("x", "d[0]", out("date", f"date_format(if(left(x.m, 2) = 'MM', {_permuted_late_date('x.d', key, reverse)}, {_permuted_date('x.d', key, reverse)}), x.m)")) + ")")
    area, group, serial = "cast(substr(v, 1, 3) as int)", "cast(substr(v, 5, 2) as int)", "cast(substr(v, 8, 4) as int)"
    valid_ssn = f"{area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0"
    ssn = _bind("f", feistel(f"({area} - if({area} > 666, 2, 1)) * 99 + {group} - 1", f"{serial} - 1", "88902", "9999", key, "ssn", reverse), _bind("n", "cast(f.l div 99 as int)", "concat_ws('-', lpad(n + if(n >= 665, 2, 1), 3, '0'), lpad(f.l % 99 + 1, 2, '0'), lpad(f.r + 1, 4, '0'))"))
    ten = _bind("d", f"right({_digits('v')}, 10)", _bind("f", feistel("cast(substr(d, 1, 3) as int)", "cast(substr(d, 4) as bigint)", "1000", "10000000", key, "phone", reverse), "concat(lpad(f.l, 3, '0'), lpad(f.r, 7, '0'))"))
    phone = _bind("t", ten, _bind("y", f"concat(left({_digits('v')}, length({_digits('v')}) - 10), t)", _filled("v", "y")))
    card = _bind("d", _digits("v"), _bind("m", "substr(d, 2, length(d) - 2)", _bind("p", f"concat(left(d, 1), {_permuted_digits('m', key, 'card', reverse)})", _bind("y", f"concat(p, (10 - {_luhn_sum('p', 0)} % 10) % 10)", _filled("v", "y")))))
    plain = "replace(v, ' ', '')"
    iban = _bind("w", plain, _bind("d", _digits("substr(w, 5)"), _bind("e", _permuted_digits("d", key, "iban", reverse), _bind("n", _filled("substr(w, 5)", "e"), _bind("y", f"concat(lpad(98 - {_mod97("concat(n, substr(w, 1, 2), '00')")}, 2, '0'), e)", _filled("v", "y"))))))
    return f"""case
      when v rlike '^(?i:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key)\\\\s*[=:]' then {out('secret', secret)}
      when v rlike '^(AKIA[0-9A-Z]|gh[pousr]_|sk-)' then {out('access_key', access)}
      when contains(v, '@') then {out('email', email)}
      when v rlike '^[A-Z]{{2}}[0-9]{{2}}' then if(length({plain}) between 15 and 34 and {_mod97(f"concat(substr({plain}, 5), substr({plain}, 1, 4))")} = 1, {out('iban', iban)}, null)
      when v rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then if(forall({octets}, x -> x < 256), {out('ip', ip)}, null)
      when v rlike '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}([./-])[0-9]{{2}}[./-][0-9]{{4}})$' then {date}
      when v rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then if({valid_ssn}, {out('ssn', ssn)}, null)
      when length({_digits('v')}) in (10, 11) then {out('phone', phone)}
      when v rlike '^[0-9 -]+$' and length({_digits('v')}) between 13 and 19 then if({_luhn_sum(_digits('v'), 1)} % 10 = 0, {out('card', card)}, null)
    end"""


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", reverse: bool = False) -> DataFrame:
    """Replace private values in whole texts; no shuffle, no Python, one row a document.

    Numbers and dates are validated (Luhn, mod 97, octets, calendar, assigned ranges) and then permuted
    within their format by a keyed Feistel network: a card number stays a valid card number with its network's digit and
    separators, a date stays a date in its notation (1900-01-01 to 2100-05-01; to 2100-07-31 with the month first). A value has the same
    pseudonym in all documents, and two numbers or dates of a notation never share one. A date that can be read day first is; one that is
    written month first and has a day above 12 gets such a date again, so it is linked with others of that notation only. With
    the key, ``reverse`` brings numbers and dates back. Emails (96 bits), secrets and access keys have no
    such format: they become a keyed digest, equal for equal values. What fails its validation stays.

    Returns doc_id, n_found, kinds (sorted, comma-joined), pseudonyms (array, in order) and text. A null text stays null with
    n_found 0, an empty one empty; a null id is carried along; repeated rows give repeated results;
    other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"))
    pattern = _q(PATTERN)
    scan = f"""transform(array(transform(regexp_extract_all(body, {pattern}, 0), v -> named_struct('v', v, 'x', {replacement(key, reverse)}))), found -> named_struct(
        'x', filter(transform(found, p -> p.x), x -> x is not null),
        'text', array_join(flatten(zip_with(split(body, {pattern}, -1), found, (s, p) -> array(s, if(p is null, '', coalesce(p.x.new, p.v))))), '')))[0]"""
    scanned = rows.withColumn("scan", F.when(F.col("body").rlike(PREFILTER), F.expr(scan)))
    none = F.array().cast("array<string>")
    return scanned.select(
        "doc_id",
        F.coalesce(F.size(F.col("scan.x")), F.lit(0)).cast("long").alias("n_found"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("scan.x", lambda x: x["kind"]))), ","), F.lit("")).alias("kinds"),
        F.coalesce(F.transform("scan.x", lambda x: x["new"]), none).alias("pseudonyms"),
        F.coalesce("scan.text", "body").alias("text"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(load(spark, sf_dir, "documents"), KEY)
