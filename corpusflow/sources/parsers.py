"""Readers of single files: bytes in, text units out. An unreadable file is a unit with an error, never a failure.

Office files are zipped XML and are read with the standard library. PDF and images need what this package doesn't bring:
they are read where a reader is installed or plugged in, and are reported otherwise.
"""

from __future__ import annotations

import inspect
import io
import re
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial
from xml.etree import ElementTree

from corpusflow.config import ParseOptions
from corpusflow.functions.tables import html_tables_to_csv, sniff_csv, to_csv_text

_a = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


@dataclass
class Unit:
    source_type: str
    locator: str
    content: str
    metadata: dict = field(default_factory=dict)


Reader = Callable[[bytes, str], list[Unit]]
#: What a blank paragraph consists of, as everywhere in this package.
BLANKS = " \t\r\n\f"
IMAGES = [f".{x}" for x in "bmp jpeg jpg png tif tiff webp".split()]


def decode(data: bytes) -> str:
    return data.decode("utf-8", errors="ignore")


def read_text(data: bytes, path: str) -> list[Unit]:
    return [Unit("txt", "text:all", decode(data))]


def markdown_sections(text: str) -> list[tuple[list[str], str]]:
    """(heading path, content) of each section; the twin of ``operators.chunking.markdown_sections`` for one file."""
    sections: list[tuple[list[str], list[str]]] = [([], [])]
    path: list[str] = []
    opened = False
    for line in text.splitlines():
        mark = line.strip()
        if mark.startswith("#"):
            level = len(mark) - len(mark.lstrip("#"))
            path = [*(path[: level - 1] if level <= len(path) else path), mark[level:].strip()]
            if opened or sections[-1][1]:
                sections.append((path, []))
            else:
                sections[-1] = (path, [])
        opened = True
        sections[-1][1].append(line)
    return [(p, "\n".join(lines)) for p, lines in sections if lines]


def read_markdown(data: bytes, path: str) -> list[Unit]:
    return [Unit("md", f"md-section:{n}", text, {"heading_path": heading, "section_index": n}) for n, (heading, text) in enumerate(markdown_sections(decode(data)), 1)]


def read_csv(data: bytes, path: str) -> list[Unit]:
    rows, header = sniff_csv(decode(data).removeprefix("﻿"))
    if not rows:
        return []
    if not header:
        rows = [[str(i) for i in range(len(rows[0]))], *rows]
    names = [c.strip() for c in rows[0]]
    return [Unit("csv", "csv:all", to_csv_text(rows), {"num_rows": len(rows) - 1, "num_cols": len(names), "columns": names, "content_format": "csv"})]


def read_docx(data: bytes, path: str) -> list[Unit]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = ["".join(t.text or "" for t in p.iter(f"{_w}t")) for p in root.iter(f"{_w}p")]
    text = "\n\n".join(p for p in paragraphs if p.strip(BLANKS))
    return [Unit("docx", "doc:all", text)] if text else []


def read_pptx(data: bytes, path: str) -> list[Unit]:
    """One unit per slide and one, as CSV, per table on it."""
    units: list[Unit] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((int(m[1]), m[0]) for m in (re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n) for n in z.namelist()) if m)
        for number, (_, name) in enumerate(slides, 1):
            root = ElementTree.fromstring(z.read(name))
            paragraph = lambda p: "".join(t.text or "" for t in p.iter(f"{_a}t"))
            bodies = [b for b in root.iter() if b.tag.endswith("}txBody")]
            cells = {id(b) for tc in root.iter(f"{_a}tc") for b in tc.iter() if b.tag.endswith("}txBody")}
            shapes = ["\n".join(paragraph(p) for p in b.iter(f"{_a}p")).strip() for b in bodies if id(b) not in cells]
            meta = {"slide_number": number, "slide_count": len(slides)}
            units.append(Unit("pptx", f"slide:{number}", "\n\n".join(s for s in shapes if s), meta))
            for t, table in enumerate(root.iter(f"{_a}tbl"), 1):
                rows = [["\n".join(paragraph(p) for p in tc.iter(f"{_a}p")) for tc in tr.iter(f"{_a}tc")] for tr in table.iter(f"{_a}tr")]
                units.append(Unit("pptx", f"slide:{number}/table:{t}", to_csv_text(rows), meta | dict(table_index=t, content_format="csv", extractor="pptx")))
    return units


def table_unit(rows: list[list[str | None]], page: int, index: int) -> Unit | None:
    """A table found on a page. Blank rows go; the first row is the header if its cells are all different."""
    rows = [[(c or "").strip() for c in r] for r in rows]
    rows = [r for r in rows if any(r)]
    if not rows:
        return None
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    if len(set(rows[0])) != len(rows[0]):
        rows = [[str(i) for i in range(width)], *rows]
    meta = {"page_number": page, "table_index": index, "content_format": "csv", "extractor": "pdfplumber", "num_rows": len(rows) - 1, "num_cols": width, "columns": rows[0]}
    return Unit("pdf", f"page:{page}/table:{index}", to_csv_text(rows), meta)


def read_pdf(data: bytes, path: str, tables_as_csv: bool = True) -> list[Unit]:
    """One unit per page by pypdf, and one per table where pdfplumber is installed too and tables are wanted."""
    try:
        import pypdf
    except ImportError as error:
        raise RuntimeError("reading PDF needs pypdf, or a reader given for .pdf") from error
    pages = pypdf.PdfReader(io.BytesIO(data)).pages
    units = [Unit("pdf", f"page:{n}", page.extract_text() or "", {"page_number": n, "page_count": len(pages)}) for n, page in enumerate(pages, 1)]
    if not tables_as_csv:
        return units
    try:
        import pdfplumber
    except ImportError:
        return units
    with pdfplumber.open(io.BytesIO(data)) as document:
        for n, page in enumerate(document.pages, 1):
            tables = next((t for way in ("lines", "text") if (t := page.extract_tables(dict.fromkeys(("vertical_strategy", "horizontal_strategy"), way)))), [])
            units += [u for t, rows in enumerate(tables, 1) if (u := table_unit(rows, n, t))]
    return units


def image_reader(ocr: Callable[[bytes], str], caption: Callable[[bytes], str] | None = None, engine: str = "plugged") -> Reader:
    """A reader of images from a function that reads text and one that describes; nothing where both are blank."""

    def read(data: bytes, path: str) -> list[Unit]:
        said, seen = (caption(data) if caption else "").strip(), ocr(data).strip()
        parts = ([f"Caption: {said}"] if said else []) + ([f"OCR: {seen}" if said else seen] if seen else [])
        where = "image:caption+ocr" if said else "image:ocr"
        return [Unit("image", where, "\n\n".join(parts), {"ocr_engine": engine, "has_caption": bool(said)})] if parts else []

    return read


@dataclass
class Element:
    """What a high-fidelity engine finds in a file."""

    category: str
    text: str
    page: int | None = None
    html: str | None = None
    coordinates: list[list[float]] | None = None


def element_units(elements: list[Element], source_type: str, infer_tables: bool = True) -> list[Unit]:
    """Elements as units: blank ones go, and tables become CSV if their HTML is known and that is wanted."""
    units = []
    for e in elements:
        table = html_tables_to_csv(e.html) if infer_tables and e.category == "Table" and e.html else ""
        content = table or e.text
        if not (content or "").strip():
            continue
        meta = {"page_number": e.page, "element_type": e.category, "coordinates": e.coordinates, "extractor": "elements"}
        if table:
            meta |= {"content_format": "csv", "table_html": e.html}
        where = [f"page:{e.page}"] if e.page is not None else []
        units.append(Unit(source_type, "/".join([*where, f"elt:{e.category}"]), content, meta))
    return units


def element_reader(partition: Callable[[bytes, str], list[Element]], basic: Reader | None = None, infer_tables: bool = True) -> Reader:
    """A reader by an element engine that falls back to a basic reader where the engine fails or finds nothing."""

    def read(data: bytes, path: str) -> list[Unit]:
        kind = path.rsplit(".", 1)[-1].lower()
        try:
            units = element_units(partition(data, path), kind, infer_tables)
        except Exception:
            units = []
            if basic is None:
                raise
        return units or (basic(data, path) if basic else [])

    return read


READERS: dict[str, Reader] = {
    ".txt": read_text,
    ".log": read_text,
    ".md": read_markdown,
    ".markdown": read_markdown,
    ".csv": read_csv,
    ".docx": read_docx,
    ".pptx": read_pptx,
    ".pdf": read_pdf,
}


def readers_for(
    options: ParseOptions, partition: Callable[..., list[Element]] | None = None, ocr: Callable[..., str] | None = None, caption: Callable[..., str] | None = None,
    basic: dict[str, Reader] | None = None,
) -> dict[str, Reader]:
    """The readers that ``options`` ask for, by extension.

    ``engine="elements"`` reads every type by ``partition``, which gets the PDF strategy and the OCR languages where it
    has parameters of these names, and falls back to the basic readers. Images need ``ocr`` (which gets the languages),
    and are described by ``caption`` (which gets the number of tokens) where captions are on.
    """
    found = {**READERS, ".pdf": partial(read_pdf, tables_as_csv=options.pdf_tables_as_csv), **(basic or {})}
    if ocr:
        words = _with(ocr, languages=options.ocr_languages)
        seen = _with(caption, tokens=options.caption_tokens) if options.captions and caption else None
        found |= dict.fromkeys(IMAGES, image_reader(words, seen))
    if options.engine == "elements":
        if partition is None:
            raise ValueError("the engine 'elements' needs a function that partitions files")
        engine = _with(partition, strategy=options.pdf_strategy, languages=options.ocr_languages)
        found = {kind: element_reader(engine, reader, options.infer_tables) for kind, reader in found.items()}
    elif options.engine != "basic":
        raise ValueError(f"unknown engine {options.engine!r}")
    return found


def _with(function: Callable, **settings: object) -> Callable:
    """``function`` with those settings that it has parameters for."""
    return partial(function, **{k: v for k, v in settings.items() if k in inspect.signature(function).parameters})
