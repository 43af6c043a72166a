"""XLSX workbooks with the standard library: the first sheet's cells in, one sheet named Table out."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta
from io import BytesIO
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_EPOCH = datetime(1899, 12, 30)
_DATE_IDS = set(range(14, 23)) | set(range(45, 48))


def _letters(index: int) -> str:
    out = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def _place(ref: str) -> tuple[int, int]:
    letters, row = re.match(r"([A-Z]+)(\d+)", ref).groups()
    column = 0
    for x in letters:
        column = column * 26 + ord(x) - 64
    return int(row) - 1, column - 1


def read_cells(data: bytes) -> list[list[Any]]:
    """The active sheet as rows of None, str, int, float or datetime, as wide and high as its cells reach."""
    with zipfile.ZipFile(BytesIO(data)) as book:
        names = set(book.namelist())
        parse = lambda n: ElementTree.fromstring(book.read(n))
        shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in parse("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = parse("xl/styles.xml")
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_MAIN}numFmt")}
            formats = styles.find(f"{_MAIN}cellXfs")
            for x in formats if formats is not None else ():
                code = int(x.get("numFmtId", 0))
                dates.append(code in _DATE_IDS or bool(re.search(r"[dyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(code, "").lower()))))
        workbook = parse("xl/workbook.xml")
        sheets = workbook.find(f"{_MAIN}sheets")
        view = next(workbook.iter(f"{_MAIN}workbookView"), None)
        active = int(view.get("activeTab", 0)) if view is not None else 0
        target = {r.get("Id"): r.get("Target") for r in parse("xl/_rels/workbook.xml.rels")}[sheets[active].get(f"{_REL}id")]
        sheet = parse(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
    found: dict[tuple[int, int], Any] = {}
    for c in sheet.iter(f"{_MAIN}c"):
        kind, v = c.get("t", "n"), c.find(f"{_MAIN}v")
        at = _place(c.get("r"))
        if kind == "inlineStr":
            found[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
        elif v is None or v.text is None:
            continue
        elif kind == "s":
            found[at] = shared[int(v.text)]
        elif kind in ("str", "e"):
            found[at] = v.text
        elif kind == "b":
            found[at] = int(v.text)
        else:
            number, style = float(v.text), int(c.get("s", 0))
            if style < len(dates) and dates[style]:
                found[at] = _EPOCH + timedelta(microseconds=round(number * 86_400_000_000))
            else:
                found[at] = int(v.text) if re.fullmatch(r"-?\d+", v.text) else number
    height = max((r for r, _ in found), default=-1) + 1
    width = max((c for _, c in found), default=-1) + 1
    return [[found.get((r, c)) for c in range(width)] for r in range(height)]


def _cell(ref: str, x: Any) -> str:
    if x is None:
        return ""
    if isinstance(x, datetime):
        days = (x - _EPOCH) / timedelta(days=1)
        return f'<c r="{ref}" s="1"><v>{days!r}</v></c>'
    if isinstance(x, (int, float)):
        return f'<c r="{ref}"><v>{x!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(x))}</t></is></c>'


def workbook(header: Sequence[str] | None, rows: Iterable[Sequence[Any]]) -> bytes:
    """Bytes of a workbook with one sheet, Table; nulls are left blank."""
    body = []
    every = ([header] if header is not None else []) + [list(r) for r in rows]
    for i, row in enumerate(every, 1):
        body.append(f'<row r="{i}">' + "".join(_cell(f"{_letters(j)}{i}", x) for j, x in enumerate(row)) + "</row>")
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="Table" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{office}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy-mm-dd hh:mm:ss.000"/></numFmts><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="164" applyNumberFormat="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{"".join(body)}</sheetData></worksheet>',
    }
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, head + text)
    return out.getvalue()
