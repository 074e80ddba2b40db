"""Personal data: format-preserving pseudonyms by keyed Feistel permutations.

Candidates are found by one pattern over whole texts, told apart and validated
(Luhn sum of cards, real dates, ranges of address octets and of social security
numbers).  The digits of a valid one are permuted by a Feistel network over
``Z_a x Z_b`` whose round function is a keyed hash, so equal values get equal
pseudonyms in every document, different ones get different ones, and the
result is valid in the same format.  Separators stay where they are.  Mail
addresses, key ids and secrets aren't numbers; they get keyed hashes spelt in
their own alphabet.

All of it is DataFrame expressions.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Setting of the session that holds the secret key of pseudonyms.
KEY_SETTING = "spark.lodestrata.pii.key"
ROUNDS = 8
_DATE = r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/(?:19|20)[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.(?:19|20)[0-9]{2})(?![0-9]|[./-][0-9])"
_IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
_LOCAL = r"(?<![0-9])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
# A group of a number isn't the start of one of another kind.
_FOURS = r"(?:[0-9]{4}[ -]){3}[0-9]{4}"
_CARD_AHEAD = rf"(?<![0-9-])(?:[0-9]{{13}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}}(?![0-9])|{_FOURS}(?:[ -]{_FOURS})*+(?![0-9]|[ -][0-9]{{4}}(?![0-9])))"
_NOT_OTHER = rf"(?!{_DATE}|{_IP}|{_SSN}|{_LOCAL})"
_GROUP = rf"(?:[ .-]?{_NOT_OTHER}(?!{_CARD_AHEAD})[0-9]{{2,4}})"
_SIXTEEN = "[^0-9]{0,2}[0-9]" * 16  # written out, for a look-behind
# Groups that may repeat without bound are possessive: those are matched in a loop, others by recursion, which a long
# text would exhaust.
# What counts as a candidate, in the order in which kinds are tried.  Numbers of country 1 have fixed
# groups; of others as many groups are taken as 15 digits allow.  A card's candidate is a whole row of groups of digits.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": r"(?i:password|passwd|pwd|secret|api_?key|token)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_/+.-]{8,}[\"']?",
    "key_id": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "date": _DATE,
    "ip": _IP,
    "ssn": _SSN,
    "phone": r"(?<![0-9+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    rf"|(?<![0-9+])(?:\+[0-9]{{1,3}}[ .-]?)(?:\([0-9]{{2,4}}\)[ .-]?)?[0-9]{{2,4}}{_GROUP}{{1,4}}(?![0-9]|\.[0-9])(?<!\+{_SIXTEEN}[0-9 ().-]{{0,30}})|{_LOCAL}",
    "card": rf"(?<![0-9])(?=(?:[0-9][ -]?){{13}})[0-9]++(?:[ -]{_NOT_OTHER}[0-9]++)*+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Groups of digits that make a card by themselves, beside other numbers in the same row.
SHAPES = ((4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4), *((n,) for n in range(13, 20)))
DATE_START, DATE_DAYS = "1900-01-01", 73049  # to 2099-12-31


def _hash(key: str, bound: Column | int, *parts: Column) -> Column:
    """A keyed number below ``bound``."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    number = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")
    return F.pmod(number, F.lit(bound) if isinstance(bound, int) else bound)


def feistel(x: Column, a: Column, b: Column, key: str, tweak: Column, backwards: bool = False) -> Column:
    """A keyed permutation of 0 <= x < a * b; ``tweak`` tells permutations of one key apart."""
    a, b = a.cast("bigint"), b.cast("bigint")
    # Division as double would lose digits of large numbers; ``div`` is exact.
    start = F.struct(F.call_function("div", x, b).cast("bigint").alias("l"), F.pmod(x, b).cast("bigint").alias("r"))
    sign = -1 if backwards else 1

    def step(acc: Column, i: Column) -> Column:
        left = F.pmod(acc["l"] + _hash(key, a, tweak, i, acc["r"]) * sign, a)
        right = F.pmod(acc["r"] + _hash(key, b, tweak, i, acc["l"]) * sign, b)
        return F.struct(
            F.when(i % 2 == 0, left).otherwise(acc["l"]).cast("bigint").alias("l"),
            F.when(i % 2 == 0, acc["r"]).otherwise(right).cast("bigint").alias("r"),
        )

    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if backwards else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(turns, start, step, lambda acc: acc["l"] * b + acc["r"])


def walk(x: Column, a: int, b: int, key: str, tweak: Column, valid: Callable[[Column], Column], most: int) -> Column:
    """``feistel`` again and again until the value is valid; a permutation of the valid values."""
    start = F.struct(x.alias("v"), F.lit(False).alias("done"))

    def step(acc: Column, _: Column) -> Column:
        following = F.struct(feistel(acc["v"], F.lit(a), F.lit(b), key, tweak).alias("v"), F.lit(True).alias("done"))
        return F.when(acc["done"] & valid(acc["v"]), acc).otherwise(following)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda acc: acc["v"])


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def refill(pattern: Column, numbers: Column) -> Column:
    """``pattern`` with its digits replaced, one after the other, by those of ``numbers``."""
    zero = F.struct(F.lit(1).alias("i"), F.lit("").alias("s"))

    def step(acc: Column, c: Column) -> Column:
        is_digit = (c >= "0") & (c <= "9")
        return F.struct(
            (acc["i"] + is_digit.cast("int")).cast("int").alias("i"),
            F.concat(acc["s"], F.when(is_digit, F.substr(numbers, acc["i"], F.lit(1))).otherwise(c)).alias("s"),
        )

    return F.aggregate(F.split(pattern, ""), zero, step, lambda acc: acc["s"])


def luhn_sum(numbers: Column, doubled: int) -> Column:
    """Luhn sum of digits; those at an index from the right with parity ``doubled`` count twice."""
    chars = F.filter(F.split(F.reverse(numbers), ""), lambda c: c != "")
    each = F.transform(chars, lambda c, i: F.when(i % 2 == doubled, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5)).otherwise(c.cast("int")).cast("int"))
    return F.aggregate(each, F.lit(0), lambda acc, v: acc + v)


def _padded(v: Column, n: Column) -> Column:
    return F.lpad(v.cast("string"), n, F.lit("0"))


def _permuted(numbers: Column, keep: Column, key: str, kind: str) -> Column:
    """Digits after the first ``keep``, at most 18, permuted."""
    rest = F.substr(numbers, keep + 1)
    n = F.char_length(rest)
    ten = lambda k: F.rpad(F.lit("1"), (k + 1).cast("int"), F.lit("0")).cast("bigint")
    half = F.floor(n / 2)
    tweak = F.concat_ws("/", F.lit(kind), F.substr(numbers, F.lit(1), keep), n.cast("string"))
    return F.concat(F.substr(numbers, F.lit(1), keep), _padded(feistel(rest.cast("bigint"), ten(n - half), ten(half), key, tweak), n))


def _is_card(d: Column) -> Column:
    return F.when(F.char_length(d).between(13, 19), (luhn_sum(d, 1) % 10 == 0) & (F.regexp_replace(d, "0", "") != "")).otherwise(F.lit(False))


def card(m: Column, key: str) -> tuple[Column, Column]:
    d = digits(m)
    body = F.left(d, F.char_length(d) - 1)
    new = _permuted(body, F.lit(1), key, "card")
    check = F.pmod(F.lit(10) - luhn_sum(new, 0) % 10, F.lit(10)).cast("string")
    return _is_card(d), refill(m, F.concat(new, check))


def phone(m: Column, key: str) -> tuple[Column, Column]:
    d = digits(m)
    n = F.char_length(d)
    keep = F.when(F.startswith(m, F.lit("+")), F.greatest(F.lit(1), n - 10)).otherwise(F.greatest(F.lit(0), n - 10))
    return n.between(7, 15), refill(m, _permuted(d, keep, key, "phone"))


def ip(m: Column, key: str) -> tuple[Column, Column]:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("bigint"))
    number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, x: acc * 256 + x)
    new = feistel(number, F.lit(65536), F.lit(65536), key, F.lit("ip"))
    parts = [F.pmod(F.shiftright(new, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]
    return ~F.exists(octets, lambda x: x > 255), F.concat_ws(".", *parts)


def ssn(m: Column, key: str) -> tuple[Column, Column]:
    def valid(v: Column) -> Column:
        area, group, serial = F.floor(v / 1_000_000), F.floor(v / 10_000) % 100, v % 10_000
        return (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)

    number = digits(m).cast("bigint")
    new = walk(number, 10**5, 10**4, key, F.lit("ssn"), valid, 40)
    return valid(number), refill(m, _padded(new, F.lit(9)))


def date(m: Column, key: str) -> tuple[Column, Column]:
    """Year first, or day, month and year; month first only where the other way is no date."""
    p = F.split(m, "[./-]")
    first = F.char_length(p[0]) == 4
    form = lambda y, mo, d: F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0"))
    parse = lambda s: F.try_to_timestamp(s, F.lit("yyyy-MM-dd")).cast("date")
    iso, day_first, month_first = parse(form(p[0], p[1], p[2])), parse(form(p[2], p[1], p[0])), parse(form(p[2], p[0], p[1]))
    value = F.when(first, iso).otherwise(F.coalesce(day_first, month_first))
    # Days up to the 12th stay among themselves, so that a date that could only be read month first still can't be read otherwise.
    start = F.lit(DATE_START).cast("date")
    late = lambda v: F.day(F.date_add(start, F.least(v, F.lit(DATE_DAYS)).cast("int"))) > 12
    new = F.date_add(
        start,
        walk(F.datediff(value, start).cast("bigint"), 271, 270, key, F.lit("date"), lambda v: (v < DATE_DAYS) & (late(v) == (F.day(value) > 12)), 60).cast("int"),
    )
    day_leads = day_first.isNotNull()
    # Day and month are padded to the width that they had, if they fit it.
    part = lambda v, like: F.when(F.char_length(like) == 2, F.lpad(v.cast("string"), 2, "0")).otherwise(v.cast("string"))
    mark = F.regexp_extract(m, "[./-]", 0)
    other = F.when(day_leads, F.concat_ws("-", part(F.day(new), p[0]), part(F.month(new), p[1]))).otherwise(F.concat_ws("-", part(F.month(new), p[0]), part(F.day(new), p[1])))
    text = F.when(first, F.concat_ws("-", F.year(new).cast("string"), part(F.month(new), p[1]), part(F.day(new), p[2]))).otherwise(F.concat_ws("-", other, F.year(new).cast("string")))
    return value.isNotNull(), F.replace(text, F.lit("-"), mark)


def _spelt(text: Column, key: str, kind: str, n: Column, alphabet: str) -> Column:
    """``n`` letters of a keyed hash of ``text``; the hash goes on as long as needed."""
    # The text is hashed once, so that a long one isn't gone through for each block of its pseudonym.
    whole = F.array(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), text), 256))
    blocks = F.flatten(F.transform(whole, lambda h: F.transform(F.sequence(F.lit(0), F.floor(n / 64).cast("int")), lambda i: F.sha2(F.concat_ws("|", F.lit(key), i.cast("string"), h), 256))))
    return F.left(F.translate(F.array_join(blocks, ""), "0123456789abcdef", alphabet), n)


def email(m: Column, key: str) -> tuple[Column, Column]:
    local = F.substring_index(m, "@", 1)
    top = F.substring_index(m, ".", -1)
    return F.lit(True), F.concat(
        _spelt(F.lower(m), key, "local", F.greatest(F.char_length(local), F.lit(8)), "abcdefghijklmnop"), F.lit("@"),
        _spelt(F.lower(m), key, "domain", F.lit(8), "abcdefghijklmnop"), F.lit("."), top,
    )


def secret(m: Column, key: str) -> tuple[Column, Column]:
    head = F.regexp_extract(m, r"^([A-Za-z_]+\s*[=:]\s*[\"']?)(.*?)([\"']?)$", 1)
    value = F.regexp_extract(m, r"^([A-Za-z_]+\s*[=:]\s*[\"']?)(.*?)([\"']?)$", 2)
    tail = F.regexp_extract(m, r"^([A-Za-z_]+\s*[=:]\s*[\"']?)(.*?)([\"']?)$", 3)
    return F.lit(True), F.concat(head, _spelt(value, key, "secret", F.char_length(value), "0123456789abcdef"), tail)


def key_id(m: Column, key: str) -> tuple[Column, Column]:
    return F.lit(True), F.concat(F.left(m, F.lit(4)), _spelt(m, key, "key_id", F.lit(16), "ABCDEFGHJKLMNPQR"))


KINDS = {"email": email, "secret": secret, "key_id": key_id, "date": date, "ip": ip, "ssn": ssn, "phone": phone, "card": card}


def pseudonym(m: Column, key: str) -> tuple[Column, Column]:
    """``(kind, replacement)`` of one candidate; the kind is null and the text as it was if no kind validates."""
    kind, out = F.lit(None).cast("string"), m
    for name in reversed(PATTERNS):
        valid, new = KINDS[name](m, key)
        # Fits as a whole; what may stand before and after has been checked in the text.
        fits = F.regexp_like(m, F.lit(f"^(?:{PATTERNS[name]})$"))
        ok = fits & F.when(fits, valid).otherwise(F.lit(False))
        kind, out = F.when(ok, F.lit(name)).otherwise(kind), F.when(ok, new).otherwise(out)
    return kind, out


def parts(m: Column) -> Column:
    """``text, tried`` of a candidate: cards of a usual shape beside other groups of digits, or else the candidate as it is."""
    row = F.split(m, "(?<=[ -])|(?=[ -])")  # groups, and separators between them

    def spans(tokens: Column) -> Column:
        def at(i: Column) -> Column:
            found = []
            for shape in SHAPES:
                n = 2 * len(shape) - 1
                d = F.array_join(F.filter(F.slice(tokens, i, F.lit(n)), lambda c: c >= "0"), "")
                right = i + n - 1 <= F.size(tokens)
                for k, size in enumerate(shape):
                    right = right & (F.char_length(F.get(tokens, i + (2 * k - 1))) == size)
                found.append(F.when(F.when(right, _is_card(d)).otherwise(F.lit(False)), F.struct(i.alias("a"), (i + n).alias("b"))))
            return F.coalesce(*found)

        return F.filter(F.transform(F.sequence(F.lit(1), F.size(tokens), F.lit(2)), at), lambda x: x.isNotNull())

    def cut(tokens: Column) -> Column:
        piece = lambda a, b, tried: F.struct(F.array_join(F.slice(tokens, a, b - a), "").alias("text"), F.lit(tried).alias("tried"))
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<text: string, tried: boolean>>").alias("out"))
        step = lambda acc, x: F.when(x["a"] < acc["at"], acc).otherwise(F.struct(x["b"].alias("at"), F.concat(acc["out"], F.array(piece(acc["at"], x["a"], False), piece(x["a"], x["b"], True))).alias("out")))
        end = lambda acc: F.when(acc["at"] > 1, F.concat(acc["out"], F.array(piece(acc["at"], F.size(tokens) + 1, False))))
        return F.aggregate(spans(tokens), start, step, end)

    whole = F.array(F.struct(m.alias("text"), F.lit(True).alias("tried")))
    several = F.regexp_like(m, F.lit(f"^(?:{PATTERNS['card']})$")) & F.regexp_like(m, F.lit("[ -]"))
    return F.coalesce(F.when(several, F.get(F.transform(F.array(row), cut), F.lit(0))), whole)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replaces ``text`` and adds ``pii`` (array of the kinds replaced, in order).

    Whoever has ``key`` can undo the permutations, so it has no default.  Null
    stays null and empty stays empty, with no kinds; nothing else in the
    text changes.  Equal rows give equal rows.  Other columns stay, but for one named ``pii``.
    """
    t = F.col(text)
    found = F.when(F.regexp_like(t, F.lit("[0-9@=:]|AKIA|ASIA")), F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))

    def one(x: Column) -> Column:
        kind, new = pseudonym(x["text"], key)
        return F.struct(F.when(x["tried"], kind).alias("kind"), F.when(x["tried"], new).otherwise(x["text"]).alias("text"))

    changed = docs.withColumn("__found", found).withColumn("__new", F.when(F.size("__found") > 0, F.transform("__found", lambda m: F.transform(parts(m), one))))
    pieces = F.zip_with(F.split(t, ANY, -1), F.col("__new"), lambda a, b: F.concat(a, F.coalesce(F.array_join(F.transform(b, lambda x: x["text"]), ""), F.lit(""))))
    kinds = F.filter(F.transform(F.flatten("__new"), lambda x: x["kind"]), lambda k: k.isNotNull())
    return (
        changed.withColumn("pii", F.coalesce(kinds, F.array().cast("array<string>")))
        .withColumn(text, F.when(F.col("__new").isNull(), t).otherwise(F.concat_ws("", pieces)))
        .drop("__found", "__new")
    )


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda k: k == kind


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session names the key; where it doesn't, pseudonyms are good for this call alone."""
    key = spark.conf.get(KEY_SETTING, None) or secrets.token_hex(16)
    found = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    counts = [F.size(F.filter("pii", _is(n))).alias(f"n_{n}") for n in PATTERNS]
    return found.select("doc_id", "text", F.size("pii").alias("n_replaced"), *counts)


QUERIES = {"op6_pii": op6_pii}
