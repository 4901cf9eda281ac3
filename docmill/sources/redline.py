"""Tracked changes and comments in DOCX files.

A clause is a range of paragraphs.  Its lines and those of the new text are aligned; a line with a partner gets a word
script, whose deleted and inserted spans become ``w:del`` and ``w:ins`` around pieces of the runs they fall in, each with
the run's own formatting; other lines become deleted or inserted paragraphs.  After each clause both readings of its
paragraphs are checked: with all changes accepted they must be the new text, with all rejected the old one.  A clause
that fails the check, or that stands in content this writer does not touch, is taken back and listed with the reason.

A file is rewritten in one task, from one row that holds it and its edits.
"""

from __future__ import annotations

import copy
import io
import re
import zipfile
from collections.abc import Iterable
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions import editing
from docmill.operators.tasks import map_rows

from .docx import W

XML_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
#: Fixed values of the package format.
DOCUMENT, COMMENTS, RELS, TYPES = "word/document.xml", "word/comments.xml", "word/_rels/document.xml.rels", "[Content_Types].xml"
COMMENTS_KIND = "application/vnd.openxmlformats-officedocument.wordprocessingml.comments+xml"
COMMENTS_LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/comments"
RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
#: Elements that are letters; that a paragraph's runs may stand in; and whose runs have a history already.
LETTERS = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
HOLDERS = tuple(f"{W}{x}" for x in ("hyperlink", "smartTag", "sdt", "sdtContent"))
TRACKED = tuple(f"{W}{x}" for x in ("ins", "del", "moveFrom", "moveTo"))
#: Words that two lines must share to be one line that has changed.
LEAST = 0.4
INTERNAL, EXTERNAL = "[INTERNAL]", "[EXTERNAL]"

EDITS = "clause_id", "first", "last", "new_text", "external_comment", "internal_note"
RESULT = "struct<redlined: binary, clean: binary, applied: array<string>, skipped: array<struct<clause_id: string, reason: string>>, error: string>"


class CannotMark(Exception):
    """A clause that stays as it is, and why."""


def parse(data: bytes) -> tuple[ElementTree.Element, dict[str, str]]:
    """The root, and the prefixes that the file declares."""
    names: dict[str, str] = {}
    tree = ElementTree.iterparse(io.BytesIO(data), events=("start-ns",))
    for _, (prefix, uri) in tree:
        names.setdefault(prefix, uri)
    return tree.root, names


def serialise(root: ElementTree.Element, names: dict[str, str]) -> bytes:
    """The file again, with every prefix it declared: attributes may name prefixes that no element uses."""
    for prefix, uri in names.items():
        if not re.fullmatch(r"ns\d+|xml", prefix):
            ElementTree.register_namespace(prefix, uri)
    out = ElementTree.tostring(root, encoding="unicode")
    head, rest = out[: out.index(">")], out[out.index(">") :]
    missing = "".join(f" xmlns:{p}={quoteattr(u)}" for p, u in names.items() if p and f"xmlns:{p}=" not in head)
    end = "/" if head.endswith("/") else ""
    return ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + head.removesuffix("/") + missing + end + rest).encode()


def runs(node: ElementTree.Element) -> Iterable[tuple[ElementTree.Element, ElementTree.Element, bool]]:
    """``(parent, run, tracked)`` of a paragraph's own runs, in order; those of text boxes inside it are others'."""
    for child in node:
        if child.tag == f"{W}r":
            yield node, child, node.tag in TRACKED
        elif child.tag in HOLDERS or child.tag in TRACKED:
            yield from runs(child)


def letters(run: ElementTree.Element) -> list[tuple[ElementTree.Element, str]]:
    """A run's content with the text of each element, which is empty for what is no letter."""
    text = lambda e: e.text or "" if e.tag in (f"{W}t", f"{W}delText") else LETTERS.get(e.tag, "")
    return [(e, text(e)) for e in run if e.tag != f"{W}rPr"]


def text_of(paragraph: ElementTree.Element) -> str:
    return "".join(t for _, run, _ in runs(paragraph) for _, t in letters(run))


def mark(paragraph: ElementTree.Element, kind: str) -> ElementTree.Element | None:
    """The change of a paragraph's own end, if it has one of this kind."""
    return paragraph.find(f"{W}pPr/{W}rPr/{W}{kind}")


def reading(paragraphs: list[ElementTree.Element], accept: bool) -> list[str]:
    """The lines that are left when all changes are accepted, or rejected.  A paragraph whose end goes is one with the next."""
    gone, out, held = ("del", "ins")[not accept], [], ""
    for p in paragraphs:
        for parent, run, tracked in runs(p):
            if not (tracked and parent.tag == f"{W}{gone}"):
                held += "".join(t for _, t in letters(run))
        if mark(p, gone) is None:
            out.append(held)
            held = ""
    return [*out, held] if held else out


def read(content: bytes, accept: bool = True) -> str:
    """The text of a file's paragraphs with its tracked changes accepted or rejected."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read(DOCUMENT))
    return "\n".join(reading(list(root.iter(f"{W}p")), accept))


def comments(content: bytes) -> list[str]:
    """The texts of a file's comments that stand at a place in it."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if COMMENTS not in z.namelist():
            return []
        there = {e.get(f"{W}id") for e in ElementTree.fromstring(z.read(DOCUMENT)).iter(f"{W}commentReference")}
        root = ElementTree.fromstring(z.read(COMMENTS))
    return ["\n".join(text_of(p) for p in c.iter(f"{W}p")) for c in root.iter(f"{W}comment") if c.get(f"{W}id") in there]


def spelled(text: str) -> str:
    """A text as a file can hold it: line ends as one character, and none that XML forbids."""
    return re.sub("[^\t\n\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]", "\ufffd", text.replace("\r\n", "\n").replace("\r", "\n"))


def piece(run: ElementTree.Element, content: list[ElementTree.Element]) -> ElementTree.Element:
    """A run with another one's formatting."""
    out = ElementTree.Element(f"{W}r", run.attrib)
    style = run.find(f"{W}rPr")
    out.extend([] if style is None else [copy.deepcopy(style)])
    out.extend(content)
    return out


def written(text: str, tag: str = "t") -> list[ElementTree.Element]:
    """Elements that spell a text."""
    out = []
    for part in re.findall(r"[^\t\n]+|[\t\n]", text):
        e = ElementTree.Element(f"{W}{ {chr(9): 'tab', chr(10): 'br'}.get(part, tag)}")
        if part not in "\t\n":
            e.text = part
            e.set(XML_SPACE, "preserve")
        out.append(e)
    return out


class Package:
    """One file, opened to be marked."""

    def __init__(self, content: bytes, author: str, date: str):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            self.parts = {n: z.read(n) for n in z.namelist()}
        self.root, self.names = parse(self.parts[DOCUMENT])
        self.paragraphs = list(self.root.iter(f"{W}p"))
        self.parent = {child: node for node in self.root.iter() for child in node}
        self.who = {f"{W}author": author, f"{W}date": date}
        self.comments, self.comment_names = parse(self.parts[COMMENTS]) if COMMENTS in self.parts else (ElementTree.Element(f"{W}comments"), {})
        ids = [e.get(f"{W}id", "") for root in (self.root, self.comments) for e in root.iter()]
        self.last_id = max((int(i) for i in ids if re.fullmatch(r"\d+", i)), default=0)

    def change(self, kind: str) -> ElementTree.Element:
        self.last_id += 1
        return ElementTree.Element(f"{W}{kind}", {f"{W}id": str(self.last_id), **self.who})

    def mark_end(self, paragraph: ElementTree.Element, kind: str) -> None:
        """Let a paragraph's own end be inserted or deleted."""
        style = paragraph.find(f"{W}pPr")
        if style is None:
            style = ElementTree.Element(f"{W}pPr")
            paragraph.insert(0, style)
        if style.find(f"{W}sectPr") is not None or mark(paragraph, "ins") is not None or mark(paragraph, "del") is not None:
            raise CannotMark("a paragraph's end cannot change here")
        own = style.find(f"{W}rPr")
        if own is None:
            own = ElementTree.Element(f"{W}rPr")
            style.append(own)  # only a section and a history of the style may follow it; the first is ruled out
            history = style.find(f"{W}pPrChange")
            if history is not None:
                style.remove(history)
                style.append(history)
        own.insert(0, self.change(kind))

    def rewrite(self, paragraph: ElementTree.Element, new: str) -> None:
        """Tracked changes that turn a paragraph's text into a line."""
        own = list(runs(paragraph))
        if any(tracked for *_, tracked in own):
            raise CannotMark("the paragraph has tracked changes already")
        spans, at, ops, inserts = editing.script(text_of(paragraph), new), 0, [], {}
        for op, text in spans:
            if op == "insert":
                inserts[at] = inserts.get(at, "") + text
            else:
                ops.append((at, at + len(text), op))
                at += len(text)
        made: list[list[ElementTree.Element]] = [[] for _ in own]
        where, before = 0, None

        def insert(k: int, run: ElementTree.Element) -> None:
            change = self.change("ins")
            change.append(piece(before if before is not None else run, written(inserts.pop(where))))
            made[k].append(change)

        for k, (_, run, _) in enumerate(own):
            for element, text in letters(run):
                end = where + len(text)
                if not text:
                    made[k].append(piece(run, [copy.deepcopy(element)]))
                while where < end:
                    if where in inserts:
                        insert(k, run)
                    _, stop, op = next(s for s in ops if s[0] <= where < s[1])
                    stop = min([stop, end, *(x for x in inserts if x > where)])
                    part = text[len(text) - (end - where) : len(text) - (end - stop)]
                    letter = [copy.deepcopy(element)] if element.tag in LETTERS else written(part, "delText" if op == "delete" else "t")
                    made[k].append(piece(run, letter))
                    if op == "delete":
                        change = self.change("del")
                        change.append(made[k].pop())
                        made[k].append(change)
                    where, before = stop, run
        if inserts:
            if own:
                insert(len(own) - 1, own[-1][1])
            else:
                change = self.change("ins")
                change.append(piece(ElementTree.Element(f"{W}r"), written(inserts.pop(where))))
                paragraph.append(change)
        for (parent, run, _), new_runs in zip(own, made, strict=True):
            place = list(parent).index(run)
            if not letters(run):
                continue
            parent.remove(run)
            for i, e in enumerate(new_runs):
                parent.insert(place + i, e)

    def after(self, paragraph: ElementTree.Element, line: str, before: bool = False) -> ElementTree.Element:
        """An inserted paragraph, styled as its neighbour."""
        own, parent = ElementTree.Element(f"{W}p"), self.parent[paragraph]
        style, first = paragraph.find(f"{W}pPr"), next(iter(runs(paragraph)), None)
        if style is not None:
            own.append(copy.deepcopy(style))
            for gone in [e for e in own[0] if e.tag in (f"{W}sectPr", f"{W}pPrChange", f"{W}rPr")]:
                own[0].remove(gone)
        if line:
            change = self.change("ins")
            change.append(piece(first[1] if first else ElementTree.Element(f"{W}r"), written(line)))
            own.append(change)
        # the new end is that of the earlier of the two, so that rejecting it joins nothing else
        self.mark_end(own if before else paragraph, "ins")
        parent.insert(list(parent).index(paragraph) + (not before), own)
        self.parent[own] = parent
        return own

    def delete(self, paragraph: ElementTree.Element, before: list[ElementTree.Element]) -> None:
        """Let a whole paragraph go.  The last one of its place keeps its end, and that of the last which stays goes."""
        self.rewrite(paragraph, "")
        earlier = next((p for p in reversed(before) if mark(p, "del") is None and mark(p, "ins") is None), None)
        inside = self.parent[paragraph]
        follows = list(inside)[list(inside).index(paragraph) + 1 :]
        if follows and follows[0].tag == f"{W}p":
            self.mark_end(paragraph, "del")
        elif earlier is not None and self.parent[earlier] is inside:
            self.mark_end(earlier, "del")
        else:
            raise CannotMark("the only paragraph of its place cannot go")

    def redline(self, first: int, last: int, new_text: str) -> list[ElementTree.Element]:
        """The clause's paragraphs with the changes; nothing has changed if it raises CannotMark."""
        if not 0 <= first <= last < len(self.paragraphs):
            raise CannotMark("the clause has no place in the file")
        own = self.paragraphs[first : last + 1]
        if any(x is not p for p in own for x in p.iter(f"{W}p")):
            raise CannotMark("the paragraph holds a text box")
        holders = list(dict.fromkeys(self.parent[p] for p in own))
        kept = [(h, list(h)) for h in holders], [(p, copy.deepcopy(p)) for p in own], self.last_id
        old, new = [text_of(p) for p in own], new_text.split("\n")
        try:
            out, lost, more = [], [], []
            rows = [*editing.aligned(old, new, LEAST), (len(old), len(new), 1.0)]
            for i, j, _ in rows:
                if i is not None and j is None:
                    lost.append(i)
                    continue
                if i is None:
                    more.append(j)
                    continue
                # between two lines with partners: lines that go and lines that come change places
                while lost and more:
                    p = own[lost.pop(0)]
                    self.rewrite(p, new[more.pop(0)])
                    out.append(p)
                lead = not out
                for k in more:
                    out.append(self.after(own[0], new[k], before=True) if lead else self.after(out[-1], new[k]))
                for k in lost:
                    self.delete(own[k], out)
                    out.append(own[k])
                lost, more = [], []
                if i < len(old):
                    if old[i] != new[j]:
                        self.rewrite(own[i], new[j])
                    out.append(own[i])
            if reading(out, True) != new or reading(out, False) != old:
                raise CannotMark("the changes do not read as they should")
            return out
        except CannotMark:
            for holder, children in kept[0]:
                holder[:] = children
            for p, before in kept[1]:
                p[:] = list(before)
            self.last_id = kept[2]
            raise

    def comment(self, paragraphs: list[ElementTree.Element], text: str) -> None:
        note = self.change("comment")
        note.set(f"{W}initials", self.who[f"{W}author"][:1].upper())
        for line in text.split("\n"):
            p = ElementTree.SubElement(note, f"{W}p")
            p.append(piece(ElementTree.Element(f"{W}r"), written(line)))
        self.comments.append(note)
        own = {f"{W}id": note.get(f"{W}id")}
        begin, end = paragraphs[0], paragraphs[-1]
        begin.insert(1 if begin.find(f"{W}pPr") is not None else 0, ElementTree.Element(f"{W}commentRangeStart", own))
        ElementTree.SubElement(end, f"{W}commentRangeEnd", own)
        ElementTree.SubElement(ElementTree.SubElement(end, f"{W}r"), f"{W}commentReference", own)

    def packed(self) -> bytes:
        """The file, with a part for comments if it has any."""
        parts = self.parts | {DOCUMENT: serialise(self.root, self.names | {"w": W[1:-1]} if "w" not in self.names else self.names)}
        if len(self.comments):
            parts[COMMENTS] = serialise(self.comments, {"w": W[1:-1]} | self.comment_names)
            links = parts.get(RELS, f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{RELATIONS}"></Relationships>'.encode()).decode()
            if COMMENTS_LINK not in links:
                links = re.sub(r"/>\s*$", "></Relationships>", links) if "</Relationships>" not in links else links
                free = max((int(x) for x in re.findall(r'Id="rId(\d+)"', links)), default=0) + 1
                links = links.replace("</Relationships>", f'<Relationship Id="rId{free}" Type="{COMMENTS_LINK}" Target="comments.xml"/></Relationships>')
            parts[RELS] = links.encode()
            kinds = parts.get(TYPES, b"").decode()
            if kinds and COMMENTS_KIND not in kinds:
                parts[TYPES] = kinds.replace("</Types>", f'<Override PartName="/{COMMENTS}" ContentType="{escape(COMMENTS_KIND)}"/></Types>').encode()
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in parts.items():
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
        return out.getvalue()


def strip_internal(content: bytes) -> bytes:
    """A copy that may leave the house: internal comments and their places are gone, and so are their words."""
    own = Package(content, "", "")
    gone = {c.get(f"{W}id") for c in own.comments.iter(f"{W}comment") if "\n".join(text_of(p) for p in c.iter(f"{W}p")).lstrip().startswith(INTERNAL)}
    if not gone:
        return content
    for c in list(own.comments):
        if c.get(f"{W}id") in gone:
            own.comments.remove(c)
    for e in list(own.root.iter()):
        if e.tag in (f"{W}commentRangeStart", f"{W}commentRangeEnd", f"{W}commentReference") and e.get(f"{W}id") in gone:
            own.parent[e].remove(e)
    if COMMENTS in own.parts:
        own.parts[COMMENTS] = serialise(own.comments, {"w": W[1:-1]} | own.comment_names)
    return own.packed()


def marked(content: bytes, edits: list[dict], author: str, date: str) -> dict:
    """A file with its edits: ``redlined``, ``clean``, ``applied``, ``skipped``."""
    own, applied, skipped, taken = Package(content, author, date), [], [], set()
    places = {}
    for e in edits:
        name, span = str(e["clause_id"]), range(e["first"] if e["first"] is not None else -1, (e["last"] if e["last"] is not None else -1) + 1)
        try:
            if not span or span[0] < 0 or span[-1] >= len(own.paragraphs):
                raise CannotMark("the clause has no place in the file")
            if e["new_text"] is not None:
                if taken & set(span):
                    raise CannotMark("another clause has changed this place")
                taken |= set(span)
                paragraphs = own.redline(span[0], span[-1], spelled(e["new_text"]))
            else:
                paragraphs = own.paragraphs[span[0] : span[-1] + 1]
            places[name] = paragraphs
            applied.append(name)
        except CannotMark as reason:
            skipped.append({"clause_id": name, "reason": str(reason)})
    # comments last, so that their places do not stand between runs that are being cut
    for e in edits:
        for tag, text in ((EXTERNAL, e["external_comment"]), (INTERNAL, e["internal_note"])):
            if text is not None and str(e["clause_id"]) in places:
                text = spelled(text)
                own.comment(places[str(e["clause_id"])], text if text.startswith(tag) else f"{tag} {text}")
    out = own.packed()
    return {"redlined": out, "clean": strip_internal(out), "applied": applied, "skipped": skipped, "error": None}


def apply(files: DataFrame, edits: DataFrame, key: str = "doc_id", content: str = "content", author: str = "reviewer", date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """``key, redlined, clean, applied, skipped, error`` of every file: the marked file, and a copy without internal comments.

    ``edits``: ``key, clause_id, first, last`` (paragraphs of the body, from 0, in ``paragraph_places``' count), ``new_text``
    (null: no redline), ``external_comment`` and ``internal_note``.  A clause that cannot be marked is in ``skipped``, and
    the file comes without it; of clauses that overlap the first is marked.  A file that cannot be read has an ``error``
    and no content; one without edits comes back with the same text.  A file and its edits meet in one row.
    """
    rows = edits.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct(F.col("first").alias("_at"), *(F.col(c) for c in EDITS)))).alias("_edits"))
    both = files.select(key, F.col(content).alias("_content")).join(rows, F.col(key) == F.col("_key"), "left").drop("_key")

    def work(row: dict) -> dict:
        try:
            return marked(row["_content"] or b"", row["_edits"] or [], author, date)
        except Exception as e:  # a broken file is a row with a reason, it does not end the run
            return {"redlined": None, "clean": None, "applied": [], "skipped": [], "error": f"{type(e).__name__}: {e}"}

    return map_rows(both, work, "_r", RESULT, ["_content", "_edits"], limit=16).select(key, "_r.*")


def readings(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` without content, with ``accepted`` and ``rejected`` (the text with all changes taken or left) and
    ``comments``; all null for a file that cannot be read."""

    def work(row: dict) -> dict | None:
        try:
            data = row[content] or b""
            return {"accepted": read(data), "rejected": read(data, accept=False), "comments": comments(data)}
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None

    kept = [c for c in files.columns if c != content]
    return map_rows(files, work, "_r", "struct<accepted: string, rejected: string, comments: array<string>>", [content], limit=16).select(*kept, "_r.*")


def paragraph_places(files: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """``key, paragraph, text``: every paragraph of every file, in the order in which ``apply`` counts them."""

    def work(row: dict) -> list[dict]:
        try:
            with zipfile.ZipFile(io.BytesIO(row[content] or b"")) as z:
                root = ElementTree.fromstring(z.read(DOCUMENT))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return []
        return [{"paragraph": i, "text": text_of(p)} for i, p in enumerate(root.iter(f"{W}p"))]

    found = map_rows(files.select(key, content), work, "_p", "array<struct<paragraph: int, text: string>>", [content], limit=16)
    return found.select(key, F.explode("_p").alias("_p")).select(key, "_p.*")


def clause_map(clauses: DataFrame, paragraphs: DataFrame, key: str = "doc_id", body: str = "body", least: float = 0.6) -> DataFrame:
    """``key, clause_id, first, last``: the paragraphs in which each clause's lines stand, null where none does.

    All lines of a document's clauses, in order, are aligned with its paragraphs, so that what stands several times is told
    apart by its place.  A line and a paragraph may differ in some of their words (``least``).
    """
    lines = clauses.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("clause_id", F.coalesce(body, F.lit("")).alias("body")))).alias("_clauses"))
    there = paragraphs.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("paragraph", "text"))).alias("_paragraphs"))
    both = lines.join(there, F.col(key) == F.col("_key"), "left").drop("_key")

    def work(row: dict) -> list[dict]:
        owner, said = [], []
        for k, c in enumerate(row["_clauses"]):
            own = [x.strip() for x in c["body"].split("\n") if x.strip()]
            owner += [k] * len(own)
            said += own
        there = [p for p in row["_paragraphs"] or [] if p["text"].strip()]
        out = [{"clause_id": c["clause_id"], "first": None, "last": None} for c in row["_clauses"]]
        for i, j, _ in editing.aligned(said, [p["text"].strip() for p in there], least):
            if i is not None and j is not None:
                own, at = out[owner[i]], there[j]["paragraph"]
                own["first"], own["last"] = at if own["first"] is None else own["first"], at
        return out

    kind = "array<struct<clause_id: string, first: int, last: int>>"
    return map_rows(both, work, "_m", kind, ["_clauses", "_paragraphs"], limit=64).select(key, F.explode("_m").alias("_m")).select(key, "_m.*")
