"""Alignment of rounds, word scripts, and the searches and files that rest on them."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docmill.functions import editing
from docmill.operators import review, rounds
from docmill.sources import docx, redline

some_words = st.lists(st.sampled_from(["a", "b", " ", ".", "ab", "é"]), max_size=12).map("".join)


def common(a, b):
    """The length of a longest common subsequence, the plain way."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(some_words, some_words, st.sampled_from([0, 1, 400]))
def test_script_gives_both_texts_back(old, new, most):
    spans = editing.script(old, new, most)
    assert "".join(t for op, t in spans if op != "insert") == old and "".join(t for op, t in spans if op != "delete") == new
    if most == 400:
        kept = sum(len(editing.tokens(t)) for op, t in spans if op == "keep")
        assert kept >= common(editing.tokens(old), editing.tokens(new)) - 2 * len(spans) and len(editing.kept_places(editing.tokens(old), editing.tokens(new))) == common(editing.tokens(old), editing.tokens(new))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.sampled_from([0.5, 0.75, 1.0])), max_size=8, unique_by=lambda p: p[:2]))
def test_heaviest_chain(pairs):
    def best(i, j):
        return max([0.0, *(w + best(x, y) for x, y, w in pairs if x > i and y > j)])

    got = editing.heaviest(pairs)
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:], strict=False))
    assert sum(w for *_, w in got) == best(-1, -1)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=7), st.lists(st.sampled_from("abc"), max_size=10), st.integers(0, 4))
def test_errors_inside(wanted, text, most):
    column = list(range(len(wanted) + 1))
    best = column[-1]
    for x in text:
        new = [0]
        for i in range(1, len(wanted) + 1):
            new.append(min(column[i - 1] + (wanted[i - 1] != x), column[i] + 1, new[-1] + 1))
        column = new
        best = min(best, column[-1])
    assert editing.errors_inside(wanted, text, most) == (best if best <= most else None)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdef"), max_size=6).map(" ".join), max_size=6), st.lists(st.lists(st.sampled_from("abcdef"), max_size=6).map(" ".join), max_size=6))
def test_alike_misses_no_pair(a, b):
    from collections import Counter

    def score(x, y):
        x, y = Counter(x.split()), Counter(y.split())
        n = sum(x.values()) + sum(y.values())
        return 2 * sum((x & y).values()) / n if n and x & y else 0.0

    want = {(i, j): score(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if score(x, y) >= 0.5}
    assert {(i, j): s for i, j, s in editing.alike(a, b, 0.5)} == pytest.approx(want)


def test_align(spark):
    prior = [(1, 1, "the buyer pays"), (1, 2, "old clause"), (1, 3, "notices go by mail"), (1, 4, "law of Korea"), (2, 1, "gone"), (3, 1, None), (None, 1, "x")]
    current = [(1, 1, "a new beginning here"), (1, 2, "the buyer pays"), (1, 3, "notices go by registered mail"), (1, 4, "law of Korea"), (1, 5, "old clause"), (3, 1, ""), (4, 9, "fresh"), (None, 2, "x")]
    schema = "doc_id long, ordinal int, text string"
    got = rounds.align(spark.createDataFrame(prior, schema), spark.createDataFrame(current, schema), "doc_id").collect()
    rows = {(r.doc_id, r.prior_no, r.current_no): (r.diff_status, r.moved) for r in got}
    assert rows == {
        (1, None, 1): ("added", False), (1, 1, 2): ("unchanged", False), (1, 2, 5): ("unchanged", True), (1, 3, 3): ("modified", False), (1, 4, 4): ("unchanged", False),
        (2, 1, None): ("removed", False), (3, 1, 1): ("unchanged", False), (4, None, 9): ("added", False), (None, 1, 2): ("unchanged", False),
    }
    none = spark.createDataFrame([], schema)
    assert rounds.align(none, none, "doc_id").collect() == []


def test_word_diff(spark):
    pairs = [(1, "The seller shall pay, at once.", "The seller may pay at once."), (2, None, "new"), (3, "old", None), (4, "", ""), (5, "same  text", "same  text"), (6, "w " * 3000, "v " * 3000)]
    got = rounds.word_diff(spark.createDataFrame(pairs, "id long, prior_text string, current_text string"), most=50)
    rows = {r.id: r for r in got.select("*", rounds.before(got.script).alias("b"), rounds.after(got.script).alias("a")).collect()}
    assert [(s.op, s.text) for s in rows[1].script] == [("keep", "The seller "), ("delete", "shall"), ("insert", "may"), ("keep", " pay"), ("delete", ","), ("keep", " at once.")]
    assert all((rows[i].b, rows[i].a) == (old or "", new or "") for i, old, new in pairs)


def nearest(wanted, text):
    return editing.errors_inside(wanted, text, len(wanted))


def test_fuzzy_paragraphs_against_all_distances(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(n)) for n in (3, 5, 9, 10, 14, 20, 23, 37, 60)] * 2 + ["one", "two words", "", None, "  "]
    paragraphs = [(i, t) for i, t in enumerate(texts)]

    def spoiled(t):
        out = t.split()
        for _ in range(r.randint(0, 1 + len(out) // 8)):
            k, what = r.randrange(len(out)), r.choice("idr")
            out[k : k + (what != "i")] = [] if what == "d" else [r.choice(words)]
        return " ".join(out)

    clauses = [(i, " ".join([*r.choices(words, k=r.randint(0, 30)), *(spoiled(r.choice(texts[:9])) for _ in range(r.randint(0, 3))), *r.choices(words, k=r.randint(0, 9))])) for i in range(60)]
    clauses += [(100, None), (101, ""), (102, "ONE  Two   words"), (103, clauses[3][1]), (3, texts[5])]
    got = review.paragraph_fuzzy(spark.createDataFrame(clauses, "doc_id long, body string"), spark.createDataFrame(paragraphs, "paragraph_id long, text string"), "doc_id")
    want = {}
    for key, body in clauses:
        for p, t in paragraphs:
            a, b = ((x or "").lower().split() for x in (t, body))
            if a and b:
                d = nearest(a, b)
                if d <= len(a) // 10:
                    want[key, p] = min(d, want.get((key, p), d))
    found = {(x.doc_id, x.paragraph_id): x.distance for x in got.collect()}
    assert found == want and {1, 2} <= set(want.values()) and len(want) > 60
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    empty = spark.createDataFrame([], "paragraph_id long, text string")
    assert review.paragraph_fuzzy(spark.createDataFrame(clauses, "doc_id long, body string"), empty, "doc_id").collect() == []


def test_fuzzy_paragraphs_in_odd_white_space(spark):
    """Words are those of the normal form, whatever stands between them; pieces of all lengths are sought in one pass."""
    r = random.Random(8)
    words, gaps = ["Ab", "c", "ΟΔΟΣ", "ß", "x\u00a0y", "é", "İ", "d", "e", "f"], [" ", "  ", "\n", "\t", "\x0b\x0c", "\r\n ", "\x1c", "\u2003"]
    said = lambda n: "".join(x for _ in range(n) for x in (r.choice(words), r.choice(gaps)))
    paragraphs = [(i, said(n)) for i, n in enumerate((1, 2, 3, 4, 6, 11, 12, 25))] + [(8, "\n"), (9, " "), (10, "\nd")]
    clauses = [(i, r.choice(["", " ", "\n", "\t d "]) + said(r.randint(0, 9)) + r.choice(paragraphs)[1] + said(r.randint(0, 3))) for i in range(50)] + [(50, "\n"), (51, "  "), (52, None), (53, " \n ")]
    got = review.paragraph_fuzzy(spark.createDataFrame(clauses, "doc_id long, body string"), spark.createDataFrame(paragraphs, "paragraph_id long, text string"), "doc_id")
    # the normal form as Spark writes it out, without blanks at its ends, cut at its single blanks
    blank = " \\\\t\\\\n\\\\x0B\\\\f\\\\r"
    rows = lambda x: spark.createDataFrame(x, "i long, s string").selectExpr("i", f"lower(trim(regexp_replace(s, '[{blank}]+', ' '))) AS n").collect()
    normal = lambda x: {r.i: r.n.split(" ") for r in rows(x) if r.n}
    want = {(i, p): nearest(a, b) for i, b in normal(clauses).items() for p, a in normal(paragraphs).items() if nearest(a, b) <= len(a) // 10}
    assert {(x.doc_id, x.paragraph_id): x.distance for x in got.collect()} == want and len(want) > 30
    # one pass: no union of a pass for each length, and no text is rewritten only to be cut up
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "regexp_replace(trim(body" not in plan


def test_short_paragraphs_without_a_cartesian_product(spark):
    r = random.Random(6)
    letters = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 4)))
    clauses = [(i, " ".join(letters() for _ in range(r.randint(0, 12)))) for i in range(80)] + [(200, None), (201, "AB  c")]
    paragraphs = [(i, " ".join(letters() for _ in range(r.randint(1, 6)))) for i in range(120)] + [(500, "b c"), (501, "B"), (502, ""), (503, None)]
    got = review.paragraph_contains(spark.createDataFrame(clauses, "doc_id long, body string"), spark.createDataFrame(paragraphs, "paragraph_id long, text string"), "doc_id")
    norm = lambda t: " ".join((t or "").lower().split())
    want = {(k, p) for k, body in clauses for p, t in paragraphs if norm(t) and body is not None and norm(t) in norm(body)}
    assert {tuple(x) for x in got.collect()} == want and len(want) > 300
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def random_file(r):
    words = ["the", "seller", "shall", "pay", "fee", "a", "b"]
    line = lambda most: " ".join(r.choice(words) for _ in range(r.randint(0, most)))
    paragraphs = [("Heading 1" if i % 3 == 0 else "", line(7)) for i in range(r.randint(1, 8))]
    tables = [[["c1 a\nb", "c2"], ["c3", "c4"]]] if r.random() < 0.4 else None
    edits, k, n = [], 0, len(paragraphs) + (4 if tables else 0)
    while k < n:
        last = min(n - 1, k + r.randint(0, 2))
        new = "\n".join(line(6) + r.choice(["", " new!"]) for _ in range(r.randint(1, 4)))
        edits.append({"clause_id": f"c{k}", "first": k, "last": last, "new_text": new if r.random() < 0.8 else None, "external_comment": "say <why> & how" if r.random() < 0.5 else None, "internal_note": "ours" if r.random() < 0.5 else None})
        k = last + 1 + r.randint(0, 1)
    return docx.build(paragraphs, tables), edits


def test_redlines_read_both_ways():
    r = random.Random(3)
    reasons = set()
    for _ in range(150):
        data, edits = random_file(r)
        out = redline.marked(data, edits, "me", "2024-01-01T00:00:00Z")
        reasons |= {s["reason"] for s in out["skipped"]}
        assert redline.read(out["redlined"], accept=False) == redline.read(data)
        done = [e for e in edits if e["clause_id"] in out["applied"]]
        old, want = redline.read(data).split("\n"), []
        at = 0
        places = redline.Package(data, "", "").paragraphs
        texts = [redline.text_of(p) for p in places]
        for e in done:
            if e["new_text"] is not None:
                want += texts[at : e["first"]] + e["new_text"].split("\n")
                at = e["last"] + 1
        assert redline.read(out["redlined"]) == "\n".join(want + texts[at:]) and "\n".join(old) == "\n".join(texts)
        assert redline.read(out["clean"]) == redline.read(out["redlined"])
        notes = redline.comments(out["redlined"])
        assert len(notes) == sum((e["external_comment"] is not None) + (e["internal_note"] is not None) for e in done)
        assert redline.comments(out["clean"]) == [x for x in notes if not x.startswith("[INTERNAL]")]
    assert reasons <= {"the only paragraph of its place cannot go"}


def test_redline_keeps_formatting_and_names():
    import io
    import zipfile

    body = (
        '<w:p><w:pPr><w:jc w:val="center"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">The seller </w:t></w:r><w:hyperlink><w:r><w:rPr><w:i/></w:rPr><w:t>shall pay</w:t></w:r></w:hyperlink><w:r><w:tab/><w:t>now.</w:t></w:r></w:p>'
        '<w:p><w:ins w:id="9" w:author="x"><w:r><w:t>tracked</w:t></w:r></w:ins></w:p><w:sectPr/>'
    )
    xml = f'<?xml version="1.0"?><w:document xmlns:w="{docx.W[1:-1]}" xmlns:w14="urn:fourteen" xmlns:mc="urn:mc" mc:Ignorable="w14"><w:body>{body}</w:body></w:document>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", xml)
        z.writestr("word/media/x.png", b"\x89")
    edits = [{"clause_id": "a", "first": 0, "last": 0, "new_text": "The seller may pay\tnow.", "external_comment": None, "internal_note": "x"}, {"clause_id": "b", "first": 1, "last": 1, "new_text": "other", "external_comment": None, "internal_note": None}, {"clause_id": "c", "first": None, "last": None, "new_text": "q", "external_comment": "e", "internal_note": None}]
    out = redline.marked(raw.getvalue(), edits, "me", "2024-01-01T00:00:00Z")
    assert out["applied"] == ["a"] and {s["clause_id"]: s["reason"] for s in out["skipped"]} == {"b": "the paragraph has tracked changes already", "c": "the clause has no place in the file"}
    with zipfile.ZipFile(io.BytesIO(out["redlined"])) as z:
        made = z.read("word/document.xml").decode()
        assert z.read("word/media/x.png") == b"\x89" and 'xmlns:w14="urn:fourteen"' in made
    assert '<w:rPr><w:i /></w:rPr><w:delText xml:space="preserve">shall</w:delText>' in made and '<w:rPr><w:i /></w:rPr><w:t xml:space="preserve">may</w:t>' in made
    assert redline.read(out["redlined"]).split("\n")[0] == "The seller may pay\tnow." and redline.read(out["redlined"], False).split("\n")[0] == "The seller shall pay\tnow."
    ids = [e.get(f"{docx.W}id") for e in redline.parse(made.encode())[0].iter() if e.tag in (f"{docx.W}ins", f"{docx.W}del")]
    assert len(ids) == len(set(ids))


def test_redline_frame(spark):
    files = spark.createDataFrame([("a", docx.build([("", "one two"), ("", "three")])), ("b", b"broken"), ("c", docx.build([("", "alone")])), ("d", None)], "doc_id string, content binary")
    edits = spark.createDataFrame([("a", "x", 0, 1, "one 2\nthree", "why?", None), ("a", "y", 0, 0, "zero", None, None), ("b", "x", 0, 0, "z", None, None)], "doc_id string, clause_id string, first int, last int, new_text string, external_comment string, internal_note string")
    got = {r.doc_id: r for r in redline.apply(files, edits).collect()}
    assert got["a"].applied == ["y"] and got["a"].skipped[0].reason == "another clause has changed this place" or got["a"].applied == ["x"]
    assert got["b"].redlined is None and "BadZipFile" in got["b"].error and got["d"].error is not None
    assert redline.read(bytes(got["c"].redlined)) == "alone"


def test_clauses_find_their_paragraphs(spark):
    files = spark.createDataFrame([("a", docx.build([("Title", "Deal"), ("", "same line"), ("", "(one)"), ("", "same line"), ("", ""), ("", "(two)"), ("", "same line"), ("", "tail of two")]))], "doc_id string, content binary")
    clauses = spark.createDataFrame([("a", "clause-001", "(one)\nsame line"), ("a", "clause-002", "(two)\nsame line\ntail  of two"), ("a", "clause-003", "nowhere to be found"), ("z", "clause-001", "no file")], "doc_id string, clause_id string, body string")
    got = {(r.doc_id, r.clause_id): (r.first, r.last) for r in redline.clause_map(clauses, redline.paragraph_places(files)).collect()}
    assert got == {("a", "clause-001"): (2, 3), ("a", "clause-002"): (5, 7), ("a", "clause-003"): (None, None), ("z", "clause-001"): (None, None)}


def test_most_alike_sets():
    r, words = random.Random(3), [f"w{i}" for i in range(60)]
    # some words are in most sets, some in few, some in none
    sets = lambda n, most: [" ".join(sorted({words[min(int(r.expovariate(0.12)), most)] for _ in range(r.randint(0, 12))})) for _ in range(n)]
    for n in (1, 300):
        asked, held = [*sets(300, 59), "", "none"], [*sets(n, 50), ""]
        at, share = editing.most_alike(pa.array(asked), pa.array(held))
        for x, i, s in zip(asked, at, share, strict=True):
            shares = [len(set(x.split()) & set(y.split())) / max(len(set(x.split()) | set(y.split())), 1) for y in held]
            assert (i, s) == (shares.index(max(shares)), max(shares))
    assert [x.tolist() for x in editing.most_alike(pa.array(["a"]), pa.array([""]))] == [[0], [0.0]]
