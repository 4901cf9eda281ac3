import hashlib
import math
import random
import re

import pytest

from docmill.llm.bpe import vocabulary
from docmill.llm.secret_scan import dictionary, find, guess_cost, scan, secrets


def spans(text):
    return [(a, b, k) for a, b, k, _ in find(text)]


def test_fixed_patterns():
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    assert spans(f"x {key}") == [(2, 22, "access")]
    assert spans("AKIAAAA") == []
    assert spans("0" * 24) == [(0, 24, "hex")] and spans("0" * 23) == []
    assert spans("API_KEY: 'abcdef'") == [(0, 16, "assign")]
    assert spans("token=abc secret=abcdef") == [(10, 23, "assign")]
    assert spans('é token = "24be64439e3e49cf46b2d7c90f3602a3"')[0] == (2, 43, "assign")


def test_kinds_at_one_place_are_ordered():
    got = spans("token=" + "a1" * 12)
    assert [k for _, _, k in got] == ["assign", "hex"]


def test_costs():
    weak = ["password", "aaaaaaaaaaaa", "qwertyuiop", "20240131", "Summer2024", "p4ssw0rd", "monkeymonkey", "x7qx7qx7qx7q"]
    strong = ["x7#Kq!9vLmZ2", "24be64439e3e49cf46b2", "gT5$hhW0pqLx"]
    assert max(map(guess_cost, weak)) < 8 < 10 < min(map(guess_cost, strong))
    assert guess_cost("") == 0
    assert guess_cost("z" * 20000) < 10


WORDS = {w: i + 1 for i, w in enumerate("password monkey hello baseball dragon pass word api key aas sdf 123".split())}


def brute(value):
    """The cheapest of all cuts, each segment of them costed alone by the definition of its kind."""
    rows = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
    at = {c: (y, x + y / 2) for y, row in enumerate(rows) for x, c in enumerate(row)}
    near = lambda a, b: a != b and a in at and b in at and abs(at[a][0] - at[b][0]) <= 1 and abs(at[a][1] - at[b][1]) <= 1
    leet = {"4": "a", "@": "a", "3": "e", "0": "o", "1": "i", "!": "i", "5": "s", "$": "s", "7": "t"}
    size = 10 * any(c in "0123456789" for c in value) + 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value) + 33 * any(not (c.isascii() and c.isalnum()) for c in value)
    each = math.log10(max(10, size))

    def segment(v):
        low, costs = "".join(c.lower() if len(c.lower()) == 1 else c for c in v), [each * len(v)]
        said = "".join(leet.get(c, c) for c in low)
        for w, factor in ((low, 1), (said, 4)):
            if w in WORDS and len(v) >= 3 and (factor == 1 or said != low):
                costs.append(math.log10(WORDS[w] * factor + 1) + 0.5 * (v != low))
        for p in (1, 2, 3, 4):
            times = len(v) // p
            if len(v) == times * p and times >= 2 and len(v) >= 3 and low == low[:p] * times:
                costs.append(p * each + math.log10(times))
        if len(v) >= 3 and all(near(a, b) for a, b in zip(low, low[1:])):
            steps = [ord(b) - ord(a) for a, b in zip(low, low[1:])]
            costs.append(math.log10(47 * len(v)) + 0.6 * sum(a != b for a, b in zip(steps, steps[1:])))
        year, month, day = "(?:19|20)[0-9]{2}", "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])"
        if re.fullmatch(f"{year}([-/._]?){month}\\1{day}", v) or re.fullmatch(f"{day}([-/._]?){month}\\1{year}", v):
            costs.append(math.log10(365 * 120))
        elif re.fullmatch(year, v):
            costs.append(math.log10(120))
        return min(costs) + 0.5

    best = [0.0]
    for j in range(1, len(value) + 1):
        best.append(min(best[i] + segment(value[i:j]) for i in range(j)))
    return best[-1]


def test_least_cost_of_all_cuts():
    r = random.Random(7)
    parts = ["password", "pass", "p4$$word", "Hello", "baseball", "asdf", "asdfgh", "qwe", "fdsa", "2024", "20240131", "31.12.1999", "aaaa", "zzzzzzz", "xyxyxy", "7q7q", "abcabcabc", "x", "K", "9", "#", "é", "İ", "sasasas", "1212", "hjhjhjhjhj"]
    values = ["apiasdfghget", "asdfghbaseball", "passwordddddddd", "Passwordfghjkl", "aaaaaaaas", "İİİaaa"]
    values += ["".join(r.choice(parts) for _ in range(r.randint(1, 5))) for _ in range(1500)]
    values += ["".join(r.choice("asdf12") for _ in range(r.randint(1, 14))) for _ in range(1500)]
    values += ["".join(r.choice("as") for _ in range(40)) for _ in range(50)] + ["".join(r.choice(["sa", "sd", "aa"]) for _ in range(20)) for _ in range(50)]
    for v in values:
        assert guess_cost(v, WORDS) == pytest.approx(brute(v), abs=1e-9), v


def test_long_values_take_linear_time():
    for v in ("z" * 200_000, "as" * 100_000, "asdfghjkl" * 20_000, "passab12" * 20_000):
        assert guess_cost(v) < 10 * len(v)


def test_words_of_a_vocabulary():
    words = dictionary(vocabulary("word_bpe_49k.json"))
    assert len(words) > 10_000 and words["password"] == 1 and all(3 <= len(w) <= 16 for w in words if w not in dictionary())
    assert guess_cost("required", words) < 5 < 10 < guess_cost("x7#Kq!9vLmZ2", words)


def test_guess_spans():
    assert spans("pwd: x7#Kq!9vLmZ2 end") == [(5, 17, "guess")]
    assert spans("pwd: password end") == []
    assert spans("Authorization: Bearer x7-Kq_9vLmZ2aa.") == [(22, 36, "guess")]
    assert spans("author: somebodyelsewrotethis") == []


def test_frame(spark):
    rows = [(1, "token=abcdef", 1), (2, None, 1), (2, "", 1), (3, "word " * 50000 + "token=abcdef", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = scan(df).collect()
    assert [r.n_assign for r in got] == [1, 0, 0, 1]
    assert got[0].spans == "assign:0:12" and got[3].spans == "assign:250000:250012"
    assert got[0].base_sha256 == hashlib.sha256(b"assign:0:12").hexdigest() and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert [r.value for r in secrets(df).collect()] == ["token=abcdef"] * 2
    assert scan(df.limit(0)).count() == 0


def test_every_context_alone_in_a_text():
    names = ["pwd", "passphrase", "passcode", "credential", "credentials", "authorization", "bearer", "password", "passwd", "secret", "token"]
    names += [a + b + "key" for a in ("private", "access", "api") for b in ("", "_", "-")]
    for name in names:
        for said in (name, name.upper(), name.title()):
            text = f"{said}: x7#Kq!9vLmZ2"
            assert [k for _, _, k in spans(text)].count("guess") == 1, text
    assert [k for _, _, k in spans('"privateKey": "x7#Kq!9vLmZ2"')] == ["guess"]
