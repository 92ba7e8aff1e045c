"""Sections of regulation XML: one part per document."""

from __future__ import annotations

import html
import io
import json
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenmill.functions.text import appendix_id, strip_section_prefix

DROPPED = frozenset(("FTREF", "CITA", "AMDDATE", "EDNOTE", "FTNT"))
RAW = "doc_id string, pos int, kind string, number string, head string, body string, own_citation string, part string, part_title string, warnings array<string>, error string"


def flat_text(el: ElementTree.Element) -> str:
    """Text of an element with that of its children, without dropped ones."""
    return "".join([el.text or "", *(x for child in el for x in ("" if child.tag in DROPPED else flat_text(child), child.tail or ""))])


def head_of(el: ElementTree.Element) -> str:
    head = el.find("HEAD")
    return flat_text(head).strip() if head is not None else ""


def json_object(text: str) -> dict | None:
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) else {}


def own_metadata(el: ElementTree.Element, warnings: list[str]) -> dict:
    """The JSON in the element's attribute, also if its quotes are written as entities twice over."""
    raw = el.get("hierarchy_metadata", "")
    found = json_object(raw) if raw else {}
    if found is None:
        found = json_object(html.unescape(raw))
    if not raw or found is None:
        warnings.append(f"{el.tag} {el.get('N')}: {'hierarchy_metadata is no JSON' if raw else 'no hierarchy_metadata'}")
    return found or {}


KINDS = {("DIV8", "SECTION"): "section", ("DIV9", "APPENDIX"): "appendix"}
#: A file of so many bytes at most is held as a tree; a larger one is gone through as a stream, twice.
WHOLE_BYTES = 1 << 20


def is_part(el: ElementTree.Element) -> bool:
    return el.tag == "DIV5" and el.get("TYPE") == "PART"


def is_container(el: ElementTree.Element) -> bool:
    return el.tag == "DIV6" and el.get("TYPE") == "SUBPART"


def no_part(el: ElementTree.Element) -> ValueError:
    return ValueError(f"expected a DIV5 of TYPE PART, got {el.tag} of {el.get('TYPE')}")


def whole(content: bytes) -> list[ElementTree.Element]:
    """What children() yields, from one tree."""
    if not (content or b"").strip():
        raise ValueError("empty XML")
    part = ElementTree.fromstring(content)
    if not is_part(part):
        raise no_part(part)
    out, todo = [part], [iter(part)]
    while todo:
        for el in todo[-1]:
            if is_container(el):
                todo.append(iter(el))
                break
            out.append(el)
        else:
            todo.pop()
    return out


def children(content: bytes) -> Iterator[ElementTree.Element]:
    """The part itself, when it begins, then its children when they are whole, with what is in subparts in their place.

    Each child is let go once the next is asked for, so one is held at a time, whatever the file's size.
    """
    if not (content or b"").strip():
        raise ValueError("empty XML")
    containers: list[ElementTree.Element] = []
    inside = 0  # elements open below the innermost container
    for event, el in ElementTree.iterparse(io.BytesIO(content), ("start", "end")):
        if event == "start":
            if not containers:
                if not is_part(el):
                    # the rest may be no XML at all, which is said first
                    rest = ElementTree.XMLParser(target=Nothing())
                    rest.feed(content)
                    rest.close()
                    raise no_part(el)
                containers.append(el)
                yield el
            elif not inside and is_container(el):
                containers.append(el)
            else:
                inside += 1
        elif inside:
            inside -= 1
            if not inside:
                yield el
                containers[-1].remove(el)
        else:
            closed = containers.pop()
            if containers:
                containers[-1].remove(closed)


class Nothing:
    """A parser's target that keeps nothing."""

    def close(self) -> None:
        pass


def survey(elements: Iterable[ElementTree.Element]) -> tuple[str, str, list[str], int]:
    """Number and title of the part, all warnings and the number of sections, of the part and its children; raises what makes the file unreadable."""
    warnings: list[str] = []
    part, title, n = None, None, 0
    for el in elements:
        kind = KINDS.get((el.tag, el.get("TYPE")))
        if part is None:
            part = el
            own_metadata(el, warnings)
        elif kind:
            n += 1
            own_metadata(el, warnings)
        elif el.tag == "HEAD" and title is None and part.find("HEAD") is el:
            title = flat_text(el).strip()
        elif el.tag not in DROPPED and el.tag not in ("HEAD", "AUTH", "SOURCE"):
            warnings.append(f"unexpected {el.tag} of {el.get('TYPE')} skipped")
    number = (part.get("N") or "").strip()
    return number, title or "", warnings if n else [*warnings, f"no sections in part {number}"], n


def parse_part(doc_id: str, content: bytes) -> Iterator[tuple]:
    """Rows of RAW, one after another.  What every row says of the file is known at its end, so its elements are gone through twice."""
    try:
        held = whole(content) if len(content or b"") <= WHOLE_BYTES else None
        part, title, warnings, n = survey(held or children(content))
    except (ValueError, ElementTree.ParseError) as problem:
        yield doc_id, 0, None, None, None, None, None, None, None, [], f"{type(problem).__name__}: {problem}"
        return
    if not n:
        yield doc_id, 0, None, None, None, None, None, part, title, warnings, None
        return
    pos = 0
    for el in held or children(content):
        kind = KINDS.get((el.tag, el.get("TYPE")))
        if kind:
            pos += 1
            cited = own_metadata(el, []).get("citation")
            body = "\n\n".join(t for t in (flat_text(p).strip() for p in el.findall("P")) if t)
            yield doc_id, pos, kind, (el.get("N") or "").strip(), head_of(el), body, cited if isinstance(cited, str) else None, part, title, warnings, None


#: Rows of a batch that a task returns, and characters of bodies in it.
BATCH_ROWS, BATCH_CHARS = 1000, 4 << 20


def parse_regulation_xml(docs: DataFrame) -> DataFrame:
    """Sections and appendices of documents (doc_id, content); a document that can't be read is a row with an error."""
    names = [f.strip().split(" ")[0] for f in RAW.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            held, size = [], 0
            for doc_id, content in zip(rows["doc_id"], rows["content"], strict=True):
                for row in parse_part(doc_id, content):
                    held.append(row)
                    size += len(row[5] or "")
                    if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
                        yield pd.DataFrame(held, columns=names)
                        held, size = [], 0
            if held:
                yield pd.DataFrame(held, columns=names)

    raw = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("content").cast("binary").alias("content")).mapInPandas(run, RAW)
    appendix = F.col("kind") == "appendix"
    section = F.when(appendix, appendix_id(F.col("number"))).when(F.col("kind") == "section", F.col("number"))
    title = F.when(appendix, F.col("head")).otherwise(strip_section_prefix(F.col("head"), F.col("number")))
    default = F.when(appendix, F.concat("part", F.lit(" CFR App. "), "number")).when(F.col("kind") == "section", F.concat("part", F.lit(" CFR §"), "number"))
    return raw.select("doc_id", "pos", section.alias("section"), title.alias("title"), "body", F.coalesce("own_citation", F.trim(default)).alias("citation"), "part", "part_title", "warnings", "error")
