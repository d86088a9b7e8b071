"""Format-preserving pseudonyms for personal data.

Personal values are found by patterns, validated (check digits, octets, real
days, assigned number ranges), and replaced in place. A validated number or date
is a whole number below a * b, the count of valid values of its format; a keyed
Feistel network on Z_a x Z_b permutes it. The result is again valid in the same
format and written with the same punctuation, and equal values get equal
pseudonyms in every document. E-mail addresses and secrets, which are no
numbers, get keyed hashes of fixed form.

Permuted within their format: payment cards (length, first digit; the check
digit is computed anew), social security numbers, IBANs (country, letters; check
digits anew), telephone numbers (country code; valid area and exchange in North
America), IPv4 addresses, dates (their century). Matches that fail validation
stay as they are.

A match that fails validation hides nothing: every kind's matches at all places
are validated, also those inside others, and of the valid ones the first from
the left is taken, then the next one behind it. An IBAN has its country's length.

Everything is built from DataFrame functions: the matches of a text are replaced
as an array, and put between the pieces of the text again. There is no shuffle.

Defined cases: a null text stays null with no replacements; empty texts and
texts without matches stay as they are; rows repeated whole give equal results;
an empty table gives an empty result; other columns, whatever their names, are
kept by ``pseudonymize`` unless they have the name of an output column, which is
lengthened then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.llm.tables import column, free_name, read_table

ROUNDS = 8

# Lengths of IBANs, by country; other codes may have any length.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "GI IL IQ OM SO TL", 24: "AD AE CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    def body(length: int) -> str:
        groups, rest = divmod(length - 4, 4)
        return f"[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")

    known = [f"(?:{c.replace(' ', '|')}){body(n)}" for n, c in IBAN_LENGTHS.items()]
    codes = "|".join(" ".join(IBAN_LENGTHS.values()).split())
    other = rf"(?!{codes})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"
    # two letters and two digits first, so that most places fail at once
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(known)}|{other})(?![A-Za-z0-9])"


# Kinds with their patterns, tried in this order at each place.
PATTERNS = {
    "secret": r"(?i:password|passwd|pwd|secret|token|api[_\-]?key)[ \t]*[=:][ \t]*\x22?[A-Za-z0-9+/_\-]{8,}\x22?",
    "access_key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]{1,63}\.){1,126}[A-Za-z]{2,}",
    "iban": _iban_pattern(),
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?<sep>[ \-])[0-9]{4}\k<sep>[0-9]{4}\k<sep>[0-9]{4}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "date": r"(?<![0-9./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9])(?:\+1[ .\-]?\(?[0-9]{3}\)?[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}|\+[0-9]{1,3}(?:[ .\-]?\(?[0-9]{2,4}\)?){2,4}|\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![0-9])",
}
ANY_KIND = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: no text without one of these characters holds a match
MAY_MATCH = "[0-9@=:]|AKIA"


def keyed_number(key: str, *parts: Column) -> Column:
    """60 bits of a keyed hash, as a long."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def keyed_hex(key: str, value: Column, length: Column | int) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    once = F.sha2(F.concat(F.lit(key + "|"), value).cast("binary"), 256)
    more = F.repeat(once, (length / 64 + 1).cast("int"))
    return F.substring(more, F.lit(1), length)


def feistel(key: str, tweak: Column, value: Column, a: Column, b: Column) -> Column:
    """Permute ``value`` in 0 .. a * b - 1, keyed, and differently for each tweak.

    The value is a pair (left, right) in Z_a x Z_b. A round adds a keyed hash of
    one half to the other, which can be undone, so all rounds are a permutation.
    """

    def step(pair: Column, i: Column) -> Column:
        left = F.pmod(pair["l"] + F.pmod(keyed_number(key, tweak, i, F.lit("l"), pair["r"]), a), a)
        right = F.pmod(pair["r"] + F.pmod(keyed_number(key, tweak, i, F.lit("r"), left), b), b)
        return F.struct(left.alias("l"), right.alias("r"))

    right = F.pmod(value, b)
    # the difference is a multiple of b and the quotient is below 2^53, so rounding is exact
    left = F.round((value - right) / b).cast("long")
    start = F.struct(left.alias("l"), right.alias("r"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, step, lambda p: p["l"] * b + p["r"]
    )


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def power_of_ten(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def refill(form: Column, signs: Column, kind: str) -> Column:
    """``form`` with its characters of class ``kind`` replaced, in order, by those of ``signs``."""
    own = lambda i: F.substring(form, i, F.lit(1))
    place = lambda i: F.length(F.regexp_replace(F.substring(form, F.lit(1), i), f"[^{kind}]", ""))
    return F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.length(form)),
            lambda i: F.when(own(i).rlike(f"[{kind}]"), F.substring(signs, place(i), F.lit(1))).otherwise(own(i)),
        ),
        "",
    )


def luhn_sum(digits: Column, first_doubled: int) -> Column:
    """Sum of the digits from the right, every second one doubled, starting with the first or second."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        doubled = 2 * d - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == first_doubled, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def mod_97(text: Column) -> Column:
    """Remainder of an IBAN's number, letters counting from A = 10."""

    def add(rest: Column, sign: Column) -> Column:
        return F.when(sign.rlike("[A-Z]"), (rest * 100 + F.ascii(sign) - 55) % 97).otherwise(
            (rest * 10 + sign.cast("int")) % 97
        )

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


class _Kind:
    """How values of one kind become numbers, and numbers values.

    ``parse`` gives (tweak, a, b, value), value null where the match is not
    valid; ``write`` gives the text for a permuted value.
    """

    @staticmethod
    def card(m: Column) -> tuple:
        d = digits_of(m)
        k = F.length(d) - 2
        valid = (F.length(d) >= 13) & (luhn_sum(d, 0) % 10 == 0)
        value = F.when(valid, F.substring(d, F.lit(2), k).cast("long"))
        half = F.floor(k / 2)
        return F.concat(F.length(d).cast("string"), F.lit("/"), F.left(d, F.lit(1))), power_of_ten(half), power_of_ten(k - half), value

    @staticmethod
    def write_card(m: Column, p: Column) -> Column:
        d = digits_of(m)
        body = F.concat(F.left(d, F.lit(1)), _padded(p, F.length(d) - 2))
        check = F.pmod(10 - luhn_sum(body, 1) % 10, F.lit(10))
        return refill(m, F.concat(body, check.cast("string")), "0-9")

    @staticmethod
    def ssn(m: Column) -> tuple:
        area, group, serial = (F.split_part(m, F.lit("-"), F.lit(i)).cast("long") for i in (1, 2, 3))
        valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        index = area - 1 - F.when(area > 666, 1).otherwise(0)
        value = F.when(valid, (index * 99 + group - 1) * 9999 + serial - 1)
        return F.lit(""), F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), value

    @staticmethod
    def write_ssn(m: Column, p: Column) -> Column:
        serial = p % 9999 + 1
        rest = F.round((p - p % 9999) / 9999).cast("long")
        area = F.floor(rest / 99) + 1
        area = area + F.when(area >= 666, 1).otherwise(0)
        return F.format_string("%03d-%02d-%04d", area, rest % 99 + 1, serial)

    @staticmethod
    def _country(m: Column) -> Column:
        """Digits of a phone number that stay: the country code as far as it is set apart."""
        apart = F.regexp_extract(m, r"^\+([0-9]{1,3})[^0-9]", 1)
        return F.when(apart != "", apart).when(m.startswith("+"), F.left(digits_of(m), F.lit(2))).otherwise("")

    @staticmethod
    def _nanp(m: Column) -> Column:
        """The ten digits of a valid North American number, else an empty text."""
        return F.regexp_extract(
            F.concat(F.when(m.startswith("+"), F.lit("+")).otherwise(F.lit("")), digits_of(m)),
            r"^(?:\+1)?([2-9][0-9]{2}[2-9][0-9]{6})$",
            1,
        )

    @staticmethod
    def phone(m: Column) -> tuple:
        n, country = _Kind._nanp(m), _Kind._country(m)
        own = F.substring(digits_of(m), F.length(country) + 1, F.lit(20))
        k = F.length(own)
        half = F.floor(k / 2)
        area, exchange, line = F.substring(n, 1, 3), F.substring(n, 4, 3), F.substring(n, 7, 4)
        american = (area.cast("long") - 200) * 8_000_000 + (exchange.cast("long") - 200) * 10_000 + line.cast("long")
        other = F.when((k >= 4) & (F.length(digits_of(m)).between(7, 15)), own.cast("long"))
        is_n = n != ""
        return (
            F.when(is_n, F.lit("1")).otherwise(F.concat(country, F.lit("/"), k.cast("string"))),
            F.when(is_n, F.lit(800).cast("long")).otherwise(power_of_ten(half)),
            F.when(is_n, F.lit(8_000_000).cast("long")).otherwise(power_of_ten(k - half)),
            F.when(is_n, american).otherwise(other),
        )

    @staticmethod
    def write_phone(m: Column, p: Column) -> Column:
        country = _Kind._country(m)
        kept = F.when(m.startswith("+"), F.lit("1")).otherwise("")
        american = F.concat(
            kept,
            (F.floor(p / 8_000_000) + 200).cast("string"),
            (F.floor(p % 8_000_000 / 10_000) + 200).cast("string"),
            _padded(p % 10_000, F.lit(4)),
        )
        other = F.concat(country, _padded(p, F.length(digits_of(m)) - F.length(country)))
        return refill(m, F.when(_Kind._nanp(m) != "", american).otherwise(other), "0-9")

    @staticmethod
    def ip(m: Column) -> tuple:
        octets = [F.split_part(m, F.lit("."), F.lit(i)) for i in (1, 2, 3, 4)]
        value, valid = F.lit(0).cast("long"), F.lit(True)
        for o in octets:
            valid = valid & (o.cast("int") <= 255) & ((o == "0") | ~o.startswith("0"))
            value = value * 256 + o.cast("long")
        return F.lit(""), F.lit(65536).cast("long"), F.lit(65536).cast("long"), F.when(valid, value)

    @staticmethod
    def write_ip(m: Column, p: Column) -> Column:
        return F.concat_ws(".", *[(F.shiftright(p, s) % 256).cast("string") for s in (24, 16, 8, 0)])

    @staticmethod
    def _day(m: Column) -> Column:
        """The date of a match; with slashes day first if that is a date, else month first."""
        part = lambda sep, i: F.split_part(m, F.lit(sep), F.lit(i)).cast("int")
        made = lambda y, mo, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, mo, d))
        return (
            F.when(m.contains("-"), made(part("-", 1), part("-", 2), part("-", 3)))
            .when(m.contains("."), made(part(".", 3), part(".", 2), part(".", 1)))
            .otherwise(
                F.coalesce(
                    made(part("/", 3), part("/", 2), part("/", 1)), made(part("/", 3), part("/", 1), part("/", 2))
                )
            )
        )

    @staticmethod
    def _century(m: Column) -> Column:
        """First day of the match's century, which begins in a year ending in 01."""
        year = F.year(_Kind._day(m))
        return F.make_date(year - F.pmod(year - 1, F.lit(100)), F.lit(1), F.lit(1))

    @staticmethod
    def date(m: Column) -> tuple:
        start = _Kind._century(m)
        # 36,525 = 75 * 487 days if the century's last year is a leap year, else 36,524 = 92 * 397
        long = (F.year(start) + 99) % 400 == 0
        value = F.datediff(_Kind._day(m), start).cast("long")
        return (
            F.year(start).cast("string"),
            F.when(long, 75).otherwise(92).cast("long"),
            F.when(long, 487).otherwise(397).cast("long"),
            F.when(F.year(start).between(1001, 2901), value),
        )

    @staticmethod
    def write_date(m: Column, p: Column) -> Column:
        day = F.date_add(_Kind._century(m), p.cast("int"))
        first, second = F.lit("d"), F.lit("M")
        part = lambda i: F.regexp_extract(m, r"^([0-9]+)[./]([0-9]+)", i).cast("int")
        padded = m.rlike(r"^[0-9]{2}[./][0-9]{2}[./]")
        month_first = m.contains("/") & (part(2) > 12)
        dm = F.when(padded, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "d/M/yyyy"))
        md = F.when(padded, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "M/d/yyyy"))
        return (
            F.when(m.contains("-"), F.date_format(day, "yyyy-MM-dd"))
            .when(m.contains("."), F.replace(dm, F.lit("/"), F.lit(".")))
            .when(month_first, md)
            .otherwise(dm)
        )

    @staticmethod
    def iban(m: Column) -> tuple:
        plain = F.replace(m, F.lit(" "), F.lit(""))
        bban = F.substring(plain, F.lit(5), F.lit(30))
        d = F.right(digits_of(bban), F.lit(18))
        k = F.length(d)
        half = F.floor(k / 2)
        valid = (mod_97(F.concat(bban, F.left(plain, F.lit(4)))) == 1) & (k >= 4)
        tweak = F.concat(F.left(plain, F.lit(2)), F.length(plain).cast("string"))
        return tweak, power_of_ten(half), power_of_ten(k - half), F.when(valid, d.cast("long"))

    @staticmethod
    def write_iban(m: Column, p: Column) -> Column:
        plain = F.replace(m, F.lit(" "), F.lit(""))
        country, bban = F.left(plain, F.lit(2)), F.substring(plain, F.lit(5), F.lit(30))
        d = digits_of(bban)
        k = F.least(F.length(d), F.lit(18))
        new = refill(bban, F.concat(F.left(d, F.length(d) - k), _padded(p, k)), "0-9")
        check = _padded(98 - mod_97(F.concat(new, country, F.lit("00"))), F.lit(2))
        return refill(m, F.concat(country, check, new), "A-Z0-9")


def _padded(number: Column, width: Column) -> Column:
    return F.lpad(number.cast("string"), width, F.lit("0"))


NUMBERS = {k: (getattr(_Kind, k), getattr(_Kind, f"write_{k}")) for k in ("iban", "card", "ssn", "date", "ip", "phone")}


def _hashed(key: str, kind: str, m: Column) -> Column:
    """Pseudonym of a value that is no number."""
    if kind == "email":
        lower = F.lower(m)
        domain = F.split_part(lower, F.lit("@"), F.lit(-1))
        return F.concat(
            F.lit("u"), keyed_hex(key, lower, 12), F.lit("@d"), keyed_hex(key, domain, 8), F.lit(".invalid")
        )
    if kind == "access_key":
        return F.concat(F.lit("AKIA"), F.upper(keyed_hex(key, m, 16)))
    head = F.regexp_extract(m, r"^([^=:]*[=:][ \t]*\x22?)", 1)
    value = F.regexp_extract(m, r"^[^=:]*[=:][ \t]*\x22?([^\x22]*)", 1)
    tail = F.when(m.endswith('"'), '"').otherwise("")
    return F.concat(head, keyed_hex(key, value, F.length(value)), tail)


CANDIDATES = "array<struct<start:int,rank:int,old:string,kind:string>>"


def candidates(text: Column) -> Column:
    """Array of structs (start, rank, old, kind): what each kind's pattern matches at each place of ``text``.

    Matches may overlap; they are in order of place and kind. Places are counted
    from 0, by the pieces of a split in front of each match.
    """

    def of_kind(rank: int, kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(f"(?=({pattern}))"), F.lit(1))
        pieces = F.split(text, f"(?={pattern})", -1)
        ends = F.aggregate(
            pieces,
            F.array(F.lit(0)),
            lambda ends, p: F.concat(ends, F.array(F.element_at(ends, -1) + F.length(p))),
        )
        # a match at the start of the text has no piece before it
        starts = F.slice(ends, F.size(ends) - F.size(found), F.size(found))
        listed = F.zip_with(
            starts, found, lambda s, m: F.struct(s.alias("start"), F.lit(rank).alias("rank"), m.alias("old"), F.lit(kind).alias("kind"))
        )
        return F.when(F.size(found) > 0, listed.cast(CANDIDATES)).otherwise(F.array().cast(CANDIDATES))

    return F.array_sort(F.concat(*[of_kind(i, k, p) for i, (k, p) in enumerate(PATTERNS.items())]))


def first_valid(found: Column) -> Column:
    """Of the valid candidates, from left to right, those that do not overlap one taken before."""
    valid = F.filter(found, lambda x: x["new"].isNotNull())
    kind = "array<struct<start:int,old:string,kind:string,new:string>>"

    def end(taken: Column) -> Column:
        last = F.try_element_at(taken, F.lit(-1))
        return F.coalesce(last["start"] + F.length(last["old"]), F.lit(0))

    return F.aggregate(
        valid,
        F.array().cast(kind),
        lambda taken, x: F.when(x["start"] >= end(taken), F.concat(taken, F.array(x).cast(kind))).otherwise(taken),
    )


def replace_matches(named: Column, key: str) -> Column:
    """Array of structs (start, old, kind, new) for an array of candidates; new is null where one is not valid."""

    def number(x: Column) -> Column:
        cases = {kind: parse(x["old"]) for kind, (parse, _) in NUMBERS.items()}
        fields = []
        for i, (name, type_) in enumerate((("tweak", "string"), ("a", "long"), ("b", "long"), ("value", "long"))):
            field = F.lit(None).cast(type_)
            for kind, case in cases.items():
                field = F.when(x["kind"] == kind, case[i].cast(type_)).otherwise(field)
            fields.append(field.alias(name))
        return F.struct(x["start"].alias("start"), x["old"].alias("old"), x["kind"].alias("kind"), *fields)

    numbers = F.transform(named, number)

    def permute(x: Column) -> Column:
        tweak = F.concat_ws("/", x["kind"], x["tweak"])
        p = F.when(x["value"].isNotNull(), feistel(key, tweak, x["value"], x["a"], x["b"]))
        return F.struct(x["start"].alias("start"), x["old"].alias("old"), x["kind"].alias("kind"), p.alias("p"))

    permuted = F.transform(numbers, permute)

    def write(x: Column) -> Column:
        new = F.lit(None).cast("string")
        for kind in PATTERNS:
            if kind in NUMBERS:
                put = F.when(x["p"].isNotNull(), NUMBERS[kind][1](x["old"], x["p"]))
            else:
                put = _hashed(key, kind, x["old"])
            new = F.when(x["kind"] == kind, put).otherwise(new)
        return F.struct(x["start"].alias("start"), x["old"].alias("old"), x["kind"].alias("kind"), new.alias("new"))

    return F.transform(permuted, write)


def pseudonymize(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``df`` with the text's personal values replaced, and columns n_replaced and kinds.

    ``key`` is the secret of the permutation: the same key links values across
    runs, another key gives unrelated pseudonyms. ``kinds`` is the array of
    distinct kinds replaced, sorted.
    """
    found, n, kinds = (free_name(df, x) for x in ("pii_found", "n_replaced", "kinds"))
    text = column(df, text_col)
    some = text.rlike(MAY_MATCH) & text.rlike(ANY_KIND)
    out = df.withColumn(found, F.when(some, candidates(text)))
    out = out.withColumn(found, F.when(F.size(found) > 0, replace_matches(F.col(found), key)))
    out = out.withColumn(found, F.when(F.size(found) > 0, first_valid(F.col(found))))
    out = out.withColumn(n, F.coalesce(F.when(F.col(found).isNotNull(), F.size(found)), F.lit(0)).cast("long"))
    out = out.withColumn(
        kinds, F.coalesce(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["kind"]))), F.array().cast("array<string>"))
    )
    # the text before each value, and what follows the last one
    ends = F.transform(found, lambda x: x["start"] + F.length(x["old"]))
    pieces = F.transform(
        found,
        lambda x, i: F.concat(_between(text, F.when(i > 0, F.get(ends, i - 1)).otherwise(0), x["start"]), x["new"]),
    )
    rest = _between(text, F.element_at(ends, -1), F.length(text))
    new_text = F.when(F.size(found) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(text)
    return out.withColumn(text_col, new_text).drop(found)


def _between(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


DEFAULT_KEY = "change-me"  # a production run passes its own secret


def op10_pii(spark, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(documents, DEFAULT_KEY).withColumn("kinds", F.array_join("kinds", ","))
