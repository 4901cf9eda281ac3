import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from docmill.llm import pii

KEY = "a key"


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_feistel_is_a_permutation_and_inverts(spark):
    for a, b in ((27, 13), (10, 100), (1, 7)):
        df = spark.range(a * b).withColumn("s", pii.feistel(F.floor(F.col("id") / b), F.col("id") % b, a, b, "k", "t"))
        df = df.withColumn("z", pii.feistel(F.col("s.l"), F.col("s.r"), a, b, "k", "t", back=True))
        rows = df.select("id", (F.col("s.l") * b + F.col("s.r")).alias("to"), (F.col("z.l") * b + F.col("z.r")).alias("back")).collect()
        assert sorted(r.to for r in rows) == list(range(a * b)) and all(r.back == r.id for r in rows)
        assert a * b < 10 or sum(r.to == r.id for r in rows) < a * b / 5


def test_letters_are_a_permutation(spark):
    every = [f"{a}{b}.{c}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz" for c in "0123456789"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in every], "x string").select(pii.letters_feistel(F.col("x"), KEY, F.lit("t"))).collect()]
    assert sorted(got) == sorted(every) and sum(a == b for a, b in zip(got, every, strict=True)) < 50


def net(l, r, a, b, tweak, rounds=8):
    """The network in plain numbers."""
    for i in range(rounds):
        h = lambda half, i=i: int(hashlib.sha256(f"{KEY}|{tweak}|{i}|{half}".encode()).hexdigest()[:15], 16)
        l, r = ((l + h(r)) % a, r) if i % 2 == 0 else (l, (r + h(l)) % b)
    return l, r


def put(v, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in v)


def halves(body, tweak):
    h = len(body) // 2
    l, r = net(int(body[:h]), int(body[h:]), 10**h, 10 ** (len(body) - h), tweak)
    return f"{l:0{h}d}{r:0{len(body) - h}d}"


def plain(kind, v):
    """The pseudonym by a version of its own, which shares no code with the operator."""
    d = re.sub(r"\D", "", v)
    if kind == "card":
        body = halves(d[:-1], f"card{len(d)}")
        return put(v, body + next(c for c in "0123456789" if luhn(body + c)))
    if kind == "intl":
        return put(v, d[:3] + halves(d[3:], f"intl{len(d)}"))
    if kind == "phone":
        codes = [x for x in range(200, 1000) if x % 100 != 11]
        ten = d[-10:]
        l, r = net(codes.index(int(ten[:3])), codes.index(int(ten[3:6])) * 10000 + int(ten[6:]), 792, 7920000, "phone")
        return put(v, f"{d[:-10]}{codes[l]}{codes[r // 10000]}{r % 10000:04d}")
    if kind == "ip":
        o = [int(x) for x in v.split(".")]
        l, r = net(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return f"{l // 256}.{l % 256}.{r // 256}.{r % 256}"
    if kind == "ssn":
        areas = [x for x in range(1, 900) if x != 666]
        l, r = net(areas.index(int(d[:3])) * 99 + int(d[3:5]) - 1, int(d[5:]) - 1, 898 * 99, 9999, "ssn")
        return put(v, f"{areas[l // 99]:03d}{l % 99 + 1:02d}{r + 1:04d}")
    if kind == "date":
        form = "%d.%m.%Y" if "." in v else "%Y/%m/%d" if "/" in v else "%Y-%m-%d"
        day = datetime.datetime.strptime(v, form).date()
        first, nxt = datetime.date(day.year // 100 * 100, 1, 1), datetime.date(day.year // 100 * 100 + 100, 1, 1)
        a, b = {36524: (92, 397), 36525: (75, 487)}[(nxt - first).days]
        l, r = net(*divmod((day - first).days, b), a, b, f"date{day.year // 100}")
        return (first + datetime.timedelta(l * b + r)).strftime(form)
    local, _, domain = v.partition("@")
    local, n = local.lower(), len(local) // 2
    l, r = local[:n], local[n:]
    for i in range(8):
        own, other = (l, r) if i % 2 == 0 else (r, l)
        stream = hashlib.sha256(f"{KEY}|email@{domain.lower()}|{i}|{other}".encode()).digest()
        own = "".join(chr((ord(c) - 97 + s) % 26 + 97) if c.isalpha() else str((int(c) + s) % 10) if c.isdigit() else c for c, s in zip(own, stream, strict=False))
        l, r = (own, r) if i % 2 == 0 else (l, own)
    return f"{l}{r}@{domain}"


VALUES = [
    ("card", "4539578763621486"), ("card", "4539 5787 6362 1486"), ("card", "378282246310005"), ("card", "3782 822463 10005"), ("phone", "+1 (499) 555-6503"), ("phone", "999-999-9999"), ("phone", "312.210.0000"),
    ("phone", "212-555-0100"), ("intl", "+44 20 7946 0958"), ("intl", "+49301234567"), ("ip", "10.0.255.1"), ("ssn", "123-45-6789"), ("ssn", "899-99-9999"), ("ssn", "667-01-0001"), ("date", "2024-02-29"), ("date", "1800-01-01"),
    ("date", "1999-12-31"), ("date", "14.03.1987"), ("date", "2199/12/31"), ("email", "that.92@mail2.example.com"), ("email", "x@y.de"), ("email", "a" * 64 + "@mail.org"),
]


def test_against_a_version_of_its_own(spark):
    df = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(VALUES)], "i int, v string").withColumn("kind", pii.kind_of(F.col("v")))
    df = df.withColumn("ok", pii.valid(F.col("v"), F.col("kind"))).withColumn("new", pii.pseudonym(F.col("v"), F.col("kind"), KEY)).withColumn("again", pii.valid(F.col("new"), pii.kind_of(F.col("new"))))
    df = df.withColumn("back", pii.pseudonym(F.col("new"), F.col("kind"), KEY, back=True)).withColumn("kind_again", pii.kind_of(F.col("new")))
    for r, (kind, v) in zip(df.orderBy("i").collect(), VALUES, strict=True):
        assert (r.kind, r.ok, r.again, r.kind_again) == (kind, True, True, kind), (v, r)
        assert r.new == plain(kind, v) != v and r.back == v
        assert kind == "ip" or re.sub(r"\d", "9", r.new.partition("@")[2] or r.new) == re.sub(r"\d", "9", v.partition("@")[2] or v)


@pytest.mark.parametrize("v", ["4539578763621487", "300.1.1.1", "000-12-3456", "666-12-3456", "2023-02-29", "31.04.2020", "000-000-0000", "911-555-0100", "212-411-0100", "+44 20 79", "a@b..com", "a" * 65 + "@b.com", "a@" + "b" * 64 + ".com"])
def test_invalid_stay(spark, v):
    text = f"a {v} b"
    assert pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), KEY).first().text == text


def test_texts(spark):
    card = "4539578763621486"
    rows = [(1, f"{card} and {card}\nIP 10.0.0.7.", "x"), (2, None, "x"), (3, "", "x"), (4, f"pay {card}", "x"), (4, f"pay {card}", "x"), (5, "plain $1 \\1 text", "x"), (6, "w " * 50000 + "2024-01-31", "x"), (7, "to That.92@Mail.example.com.", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = pii.pseudonymise(df, KEY).collect()
    new = got[3].text[4:]
    assert luhn(new) and new != card and got[3] == got[4]
    assert got[0].text.startswith(f"{new} and {new}\nIP ") and got[0].text.endswith(".") and (got[0].n_card, got[0].n_ip) == (2, 1)
    assert [r.text for r in got[1:3]] == ["", ""] and got[5].text == rows[5][1]
    assert got[6].n_date == 1 and len(got[6].text) == len(rows[6][1])
    assert got[7].text == f"to {plain('email', 'that.92@Mail.example.com')}."
    link = {r.pseudonym: (r.n_values, r.n_docs) for r in pii.links(df, KEY).collect()}
    assert link[new] == (4, 2)
    assert pii.pseudonymise(df.limit(0), KEY).count() == 0
    other = pii.pseudonymise(df, "another key").collect()
    assert other[3].text != got[3].text
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymise(df, "")


def test_hostile_texts(spark):
    n = 1_000_000
    bodies = ["x a@" + "b." * n + "com", "a@" + "b" * n, "a" * n + "@b.com", "a@" * n, "1" * n, "1-" * n, "+" * n, "1." * n, "(123) " * (n // 6), "@" * n, "+44" + " 1" * n, "123-45-6789" + "-" * n, "4 4 " * (n // 4), "a@b.co " * (n // 100)]
    df = spark.createDataFrame(list(enumerate(bodies)), "doc_id int, text string").repartition(4)
    got = {r.doc_id: r for r in pii.pseudonymise(df, KEY).collect()}
    assert len(got) == len(bodies)
    for i, body in enumerate(bodies[:-1]):
        assert got[i].text == body or sum(got[i][f"n_{k}"] for k in pii.PATTERNS), body[:20]
    assert got[len(bodies) - 1].n_email == n // 100 and got[0].n_email == 0
