"""PII: format-preserving Feistel pseudonyms of validated numbers, dates and addresses.

A value that passes its kind's validation is a number in a known range: the digits of a payment card but for its
check digit, the area, exchange and line of a phone number, the four octets of an address, the day of a date in its
century.  A keyed Feistel network over a split of that range into two factors a * b permutes it: the halves are added
to, in turn, a keyed hash of the other half, modulo a or b.  That is one-to-one for any a and b, so different values
stay different, equal values meet the same pseudonym in every document, and the key's holder can invert it.  The local
part of an e-mail address is permuted in the same way, its two halves being texts whose letters move among letters
and whose digits move among digits.  What comes out is written in the format that went in, and still passes the
validation.

Formats covered: dates yyyy-mm-dd, yyyy/mm/dd and dd.mm.yyyy of 1800 to 2199; IPv4 addresses; US social security
numbers 3-2-4; payment cards of 13 to 19 digits, 4-4-4-4 and 4-6-5, with a right check digit; North American phone
numbers; other phone numbers that begin with + and have 8 to 14 digits; e-mail addresses.  Others, such as dates with
names of months or in an order that cannot be told, stay as they are.

All of it is SQL expressions: a text is cut at its candidates, each candidate mapped, and the pieces joined.  No
pattern repeats a group without a small bound, for such repeats use the stack, which a long text would overflow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Rounds of the network; the key of the tests' tables; the setting that names another one.  The key stands in plans,
#: so logs of plans are as secret as the key.
PASSES, TEST_KEY, KEY_SETTING = 8, "docmill-test-key", "spark.docmill.pii.key"
#: Candidates by kind, tried in this order at each place: fixed formats.
PATTERNS = {
    "date": r"(?<![\d./])(?:(?:18|19|20|21)\d\d([-/])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])\.(?:0[1-9]|1[0-2])\.(?:18|19|20|21)\d\d)(?![\d/-])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]*\d)",
    "card": r"(?<!\d)(?:\d{4}[ -]){3}\d{4}(?!\d)|(?<!\d)\d{4}[ -]\d{6}[ -]\d{5}(?!\d)|(?<![\d-])\d{13,19}(?!\d)",
    "phone": r"(?<!\d)(?:\+?1[ .-]?)?\(\d{3}\)[ ]?\d{3}-\d{4}(?!\d)|(?<![\d-])(?:\+?1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]*\d)",
    "intl": r"(?<![\d+])\+[2-9]\d(?:[ .-]?\d){6,12}(?![ .-]?\d)",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
}
LOOK_BEHIND = ("(?<![\\d./])", "(?<![\\d.])", "(?<![\\d-])", "(?<![\\d+])", "(?<!\\d)", "(?<![A-Za-z0-9._%+-])")


def _inside(pattern: str, group: int) -> str:
    """A pattern as a part of a larger one, where its first group has the number ``group``."""
    return pattern.replace("\\1", f"\\{group}")


#: All but e-mail begin with a digit, + or (, which is looked at first.  The one group is that of dates.
NUMBER = r"(?=[+(\d])(?:" + "|".join(_inside(p, 1) for k, p in PATTERNS.items() if k != "email") + ")"
CANDIDATE = f"{NUMBER}|{PATTERNS['email']}"
#: Days of each century from 1800 on, as products of two factors; its first day is year * 100 + 0101.
CENTURIES = {18: (92, 397), 19: (92, 397), 20: (75, 487), 21: (92, 397)}
#: Longest local part and domain of an address, and part of a domain: fixed values.
LOCAL, DOMAIN, LABEL = 64, 255, 63


def _hash(key: str, tweak: Column | str, i: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), tweak if isinstance(tweak, Column) else F.lit(tweak), i.cast("string"), half.cast("string")), 256)


def _passes(passes: int, back: bool) -> Column:
    return F.array(*(F.lit(i) for i in (reversed(range(passes)) if back else range(passes))))


def feistel(left: Column, right: Column, a, b, key: str, tweak: str, passes: int = PASSES, back: bool = False) -> Column:
    """A keyed one-to-one map of (left < a, right < b): a struct ``l, r``.  ``back`` inverts it."""
    state = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    a, b = (m if isinstance(m, Column) else F.lit(m) for m in (a, b))

    def step(s, i):
        def hashed(half):
            return F.conv(F.substring(_hash(key, tweak, i, half), 1, 15), 16, 10).cast("long")

        put = (lambda x, h, m: F.pmod(x - F.pmod(h, m), m)) if back else (lambda x, h, m: F.pmod(x + F.pmod(h, m), m))
        to_left = F.struct(put(s["l"], hashed(s["r"]), a).cast("long").alias("l"), s["r"].alias("r"))
        to_right = F.struct(s["l"].alias("l"), put(s["r"], hashed(s["l"]), b).cast("long").alias("r"))
        return F.when(i % 2 == 0, to_left).otherwise(to_right)

    return F.aggregate(_passes(passes, back), state, step)


def letters_feistel(text: Column, key: str, tweak: Column, passes: int = PASSES, back: bool = False) -> Column:
    """A keyed one-to-one map of texts of up to 64 characters: a-z move among themselves, and so do 0-9; all else stays.

    The first half is moved by a hash of the second, and the other way round: a byte of the hash for each character.
    """
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    state = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, n - half).alias("r"))
    sign = -1 if back else 1

    def moved(own, other, i):
        stream = _hash(key, tweak, i, other)

        def one(c, at):
            by = F.conv(F.substring(stream, at * 2 + 1, F.lit(2)), 16, 10).cast("int") * sign
            code = F.ascii(c)
            shift = lambda first, size: F.char(F.pmod(code - first + by, F.lit(size)) + first)
            return F.when(code.between(97, 122), shift(97, 26)).when(code.between(48, 57), shift(48, 10)).otherwise(c)

        return F.when(own == "", own).otherwise(F.array_join(F.transform(F.split(own, ""), one), ""))

    def step(s, i):
        to_left = F.struct(moved(s["l"], s["r"], i).alias("l"), s["r"].alias("r"))
        to_right = F.struct(s["l"].alias("l"), moved(s["r"], s["l"], i).alias("r"))
        return F.when(i % 2 == 0, to_left).otherwise(to_right)

    out = F.aggregate(_passes(passes, back), state, step)
    return F.concat(out["l"], out["r"])


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _pad(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _fill(v: Column, digits: Column) -> Column:
    """``v`` with its digits replaced, in order, by those of ``digits``; everything else stays."""
    letters = F.split(v, "")
    mapped = F.aggregate(
        letters,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
    )
    return mapped["out"]


def luhn_sum(digits: Column, odd: int) -> Column:
    """The check sum of a string of digits; ``odd`` says whether the last one (0) or the one before (1) is doubled."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == odd, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _day(v: Column) -> Column:
    """The date that a candidate of the kind writes, null if there is no such day."""
    return F.when(v.contains("."), F.try_to_date(v, "dd.MM.yyyy")).otherwise(F.try_to_date(F.translate(v, "/", "-"), "yyyy-MM-dd"))


def valid(v: Column, kind: Column) -> Column:
    """Whether a candidate of ``kind`` is one: check digits, ranges, days that exist, lengths of an address."""
    d = _digits(v)
    octets = F.transform(F.split(v, "\\."), lambda x: x.cast("int"))
    last10 = F.substring(d, -10, 10)
    at = F.instr(v, "@")
    labels = F.split(F.substring(v, at + 1, F.length(v)), "\\.")
    return (
        F.when(kind == "card", (F.length(d).between(13, 19)) & (luhn_sum(d, 1) % 10 == 0) & ~d.rlike("^0+$"))
        # areas and exchanges begin with 2 to 9 and do not end in 11, which is how services are called
        .when(kind == "phone", last10.rlike("^[2-9](?!11)[0-9]{2}[2-9](?!11)[0-9]{2}[0-9]{4}$"))
        .when(kind == "intl", F.length(d).between(8, 14))
        .when(kind == "ip", F.forall(octets, lambda x: x.between(0, 255)) & ~v.rlike("(^|\\.)0[0-9]"))
        .when(kind == "ssn", ~d.rlike("^(000|666|9)|^...00|0000$"))
        .when(kind == "date", _day(v).isNotNull())
        .when(kind == "email", (at <= LOCAL + 1) & (F.length(v) - at <= DOMAIN) & F.forall(labels, lambda x: F.length(x).between(1, LABEL)))
        .otherwise(F.lit(False))
    )


def kind_of(v: Column) -> Column:
    """The first kind whose pattern is all of ``v``."""
    out = F.lit(None).cast("string")
    for name, p in reversed(PATTERNS.items()):
        bare = reduce(lambda x, y: x.replace(y, ""), LOOK_BEHIND, p)
        out = F.when(v.rlike(f"^(?:{_inside(bare, 1)})$"), name).otherwise(out)
    return out


def _three(code: Column) -> Column:
    """The ordinal of an area or exchange: 8 hundreds of 99 each."""
    rest = code % 100
    return (F.floor(code / 100) - 2) * 99 + rest - F.when(rest > 11, 1).otherwise(0)


def _of_three(ordinal: Column) -> Column:
    rest = ordinal % 99
    return (F.floor(ordinal / 99) + 2) * 100 + rest + F.when(rest >= 11, 1).otherwise(0)


def pseudonym(v: Column, kind: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of a valid value in its own format; ``back`` gives the value of a pseudonym."""
    net = lambda l, r, a, b, tweak: feistel(l, r, a, b, key, tweak, back=back)
    d = _digits(v)

    def two(body: Column, n: int, tweak: str) -> Column:
        """``n`` digits as two halves."""
        h = n // 2
        s = net(F.substring(body, 1, h).cast("long"), F.substring(body, h + 1, n - h).cast("long"), 10**h, 10 ** (n - h), tweak)
        return F.concat(_pad(s["l"], h), _pad(s["r"], n - h))

    def card(n: int) -> Column:
        """``n`` digits: all but the check digit are permuted, then the check digit is set."""
        new = two(F.substring(d, 1, n - 1), n - 1, f"card{n}")
        return F.concat(new, ((10 - luhn_sum(new, 0) % 10) % 10).cast("string"))

    by_length = lambda make, lengths: reduce(lambda rest, n: F.when(F.length(d) == n, make(n)).otherwise(rest), lengths, F.lit(None).cast("string"))
    cards = by_length(card, range(13, 20))
    # of another country's number the first three digits stay, which hold its code
    abroad = by_length(lambda n: F.concat(F.substring(d, 1, 3), two(F.substring(d, 4, n - 3), n - 3, f"intl{n}")), range(8, 15))
    ten = F.substring(d, -10, 10)
    area, exchange, line = (F.substring(ten, i, n).cast("long") for i, n in ((1, 3), (4, 3), (7, 4)))
    p = net(_three(area), _three(exchange) * 10_000 + line, 792, 7_920_000, "phone")
    phone = F.concat(F.substring(d, F.lit(1), F.length(d) - 10), _pad(_of_three(p["l"]), 3), _pad(_of_three(F.floor(p["r"] / 10_000)), 3), _pad(p["r"] % 10_000, 4))
    o = F.transform(F.split(v, "\\."), lambda x: x.cast("long"))
    q = net(o[0] * 256 + o[1], o[2] * 256 + o[3], 1 << 16, 1 << 16, "ip")
    ip = F.concat_ws(".", *(x.cast("string") for x in (F.floor(q["l"] / 256), q["l"] % 256, F.floor(q["r"] / 256), q["r"] % 256)))
    # area 001-899 without 666, group 01-99, serial 0001-9999: as ordinals from 0
    first = F.substring(d, 1, 3).cast("long")
    ordinal = F.when(first > 666, first - 2).otherwise(first - 1)
    s = net(ordinal * 99 + F.substring(d, 4, 2).cast("long") - 1, F.substring(d, 6, 4).cast("long") - 1, 898 * 99, 9999, "ssn")
    new_area = F.floor(s["l"] / 99)
    ssn = F.concat(_pad(F.when(new_area >= 665, new_area + 2).otherwise(new_area + 1), 3), _pad(s["l"] % 99 + 1, 2), _pad(s["r"] + 1, 4))

    def in_century(century: int) -> Column:
        a, b = CENTURIES[century]
        begin = F.lit(f"{century}00-01-01").cast("date")
        day = F.datediff(_day(v), begin).cast("long")
        t = net(F.floor(day / b), day % b, a, b, f"date{century}")
        return F.date_add(begin, (t["l"] * b + t["r"]).cast("int"))

    century = F.floor(F.year(_day(v)) / 100)
    new_day = reduce(lambda rest, c: F.when(century == c, in_century(c)).otherwise(rest), CENTURIES, F.lit(None).cast("date"))
    date = F.when(v.contains("."), F.date_format(new_day, "dd.MM.yyyy")).when(v.contains("/"), F.date_format(new_day, "yyyy/MM/dd")).otherwise(F.date_format(new_day, "yyyy-MM-dd"))
    at = F.instr(v, "@")
    domain = F.substring(v, at, F.length(v))
    email = F.concat(letters_feistel(F.lower(F.substring(v, F.lit(1), at - 1)), key, F.concat(F.lit("email"), F.lower(domain)), back=back), domain)
    made = {"card": _fill(v, cards), "phone": _fill(v, phone), "intl": _fill(v, abroad), "ip": ip, "ssn": _fill(v, ssn), "date": date, "email": email}
    return reduce(lambda rest, k: F.when(kind == k, made[k]).otherwise(rest), made, F.lit(None).cast("string"))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id``, the whole text, and its candidates in order."""
    text = F.coalesce(docs["text"], F.lit(""))
    found = F.when(text.contains("@"), F.regexp_extract_all(text, F.lit(CANDIDATE), 0)).otherwise(F.regexp_extract_all(text, F.lit(NUMBER), 0))
    return docs.select(F.col("doc_id"), text.alias("text"), found.alias("found"))


def _mapped(found: Column, key: str) -> Column:
    """For each candidate its kind (null if it fails validation) and what stands in its place."""

    def one(v):
        kind = kind_of(v)
        return F.struct(F.when(valid(v, kind), kind).alias("kind"), v.alias("old"))

    def two(x):
        return F.struct(x["kind"].alias("kind"), x["old"].alias("old"), F.coalesce(pseudonym(x["old"], x["kind"], key), x["old"]).alias("new"))

    return F.transform(F.transform(found, one), two)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """One row per document: ``doc_id, text`` with pseudonyms, and how many values of each kind were replaced.

    Candidates that fail their validation stay as they are.  Letters of an e-mail address's local part come out in
    lower case, for case does not tell addresses apart.  A null text counts as empty, and gives an empty text and
    zero counts.  Texts of any length are read whole, in time that grows with their length.  Repeated rows stay
    repeated; an empty table gives an empty result; other columns are ignored.  Rows never leave their partition:
    nothing shuffles, and texts without candidates are not touched.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    rows = candidates(docs).withColumn("m", F.when(F.size("found") > 0, _mapped(F.col("found"), key)))
    gaps = F.split("text", CANDIDATE, -1)
    joined = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size("m")), "m", lambda g, x: F.concat(g, x["new"])), ""), F.element_at(gaps, -1))
    count = lambda kind: F.coalesce(F.size(F.filter("m", lambda x: x["kind"] == kind)), F.lit(0)).cast("long")
    counts = [F.when(F.col("m").isNull(), F.lit(0).cast("long")).otherwise(count(k)).alias(f"n_{k}") for k in PATTERNS]
    return rows.select("doc_id", F.when(F.col("m").isNull(), F.col("text")).otherwise(joined).alias("text"), *counts)


def links(docs: DataFrame, key: str) -> DataFrame:
    """``kind, pseudonym, n_values, n_docs``: each pseudonym with the documents it links, copies pre-aggregated."""
    flat = candidates(docs).where(F.size("found") > 0).select("doc_id", F.explode(_mapped(F.col("found"), key)).alias("x")).where("x.kind is not null")
    return flat.groupBy("x.kind", F.col("x.new").alias("pseudonym")).agg(F.count("*").alias("n_values"), F.countDistinct("doc_id").alias("n_docs"))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents", spread=True), spark.conf.get(KEY_SETTING, TEST_KEY))
