"""A small spreadsheet writer: values, formulas, bold headers, prices and column widths. Rows are written as they come."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime
from pathlib import Path
from typing import Any, BinaryIO
from xml.sax.saxutils import escape, quoteattr

#: The most rows that a sheet of this format holds.
MOST_ROWS = 1_048_576
_STYLES = {"plain": 0, "bold": 1, "price": 2, "time": 3, "title": 4}


class Formula(str):
    """A formula, without its equals sign. Texts are never formulas."""


def styled(values: Iterable[Any], style: str = "plain", styles: dict[int, str] | None = None) -> list[tuple[Any, str]]:
    return [(v, (styles or {}).get(i, style)) for i, v in enumerate(values)]


@dataclass
class Sheet:
    """rows of (value, style), which may be a stream that is read once."""

    title: str
    rows: Iterable[list[tuple[Any, str]]] = field(default_factory=list)
    widths: Sequence[float] = ()


def column_name(index: int) -> str:
    """A, B, ... Z, AA, ... for 0, 1, ..."""
    name = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        name = chr(65 + rest) + name
    return name


def _cell(reference: str, value: Any, style: str) -> str:
    if value is None:
        return ""
    if isinstance(value, datetime | date):
        moment = value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)
        days = (moment - datetime(1899, 12, 30)).total_seconds() / 86400
        return f'<c r="{reference}" s="{_STYLES["time"]}"><v>{days!r}</v></c>'
    head = f'<c r="{reference}" s="{_STYLES[style]}"'
    if isinstance(value, bool):
        return f'{head} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f"{head}><v>{value!r}</v></c>"
    if isinstance(value, Formula):
        return f"{head}><f>{escape(value)}</f></c>"
    clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
    return f'{head} t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'


def _sheet_xml(sheet: Sheet) -> Iterable[str]:
    yield '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
    if sheet.widths:
        yield "<cols>" + "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(sheet.widths, 1)) + "</cols>"
    yield "<sheetData>"
    for n, row in enumerate(sheet.rows, 1):
        if n > MOST_ROWS:
            raise ValueError(f"sheet {sheet.title} has more than {MOST_ROWS} rows")
        yield f'<row r="{n}">' + "".join(_cell(f"{column_name(i)}{n}", v, s) for i, (v, s) in enumerate(row)) + "</row>"
    yield "</sheetData></worksheet>"


def sheet_titles(titles: Iterable[str]) -> list[str]:
    """Titles as the format allows them: at most 31 characters, some replaced, no two alike."""
    found: list[str] = []
    for title in titles:
        name = base = re.sub(r"[\\/?*\[\]:]", "_", title)[:31] or "Sheet"
        n = 1
        while name.lower() in (f.lower() for f in found):
            n += 1
            name = f"{base[: 31 - len(str(n)) - 1]}_{n}"
        found.append(name)
    return found


def write_workbook(file: str | Path | BinaryIO, sheets: Iterable[Sheet]) -> None:
    """Writes the sheets one after another to a file or an open stream; only one row is held at a time."""
    main, relations = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    fonts = '<fonts count="3"><font><sz val="10"/><name val="Arial"/></font><font><b/><sz val="10"/><name val="Arial"/></font><font><b/><sz val="12"/><name val="Arial"/></font></fonts>'
    formats = '<numFmts count="2"><numFmt numFmtId="164" formatCode="$#,##0.00"/><numFmt numFmtId="165" formatCode="yyyy-mm-dd hh:mm:ss"/></numFmts>'
    cells = "".join(f'<xf numFmtId="{n}" fontId="{f}" fillId="0" borderId="0" applyNumberFormat="1" applyFont="1"/>' for n, f in ((0, 0), (0, 1), (164, 0), (165, 0), (0, 2)))
    styles = f'{head}<styleSheet xmlns="{main}">{formats}{fonts}<fills count="1"><fill><patternFill patternType="none"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="5">{cells}</cellXfs></styleSheet>'
    titles: list[str] = []
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as out:
        for sheet in sheets:
            titles.append(sheet.title)
            with out.open(f"xl/worksheets/sheet{len(titles)}.xml", "w", force_zip64=True) as part:
                for piece in _sheet_xml(sheet):
                    part.write(piece.encode())
        count = len(titles)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for n in range(1, count + 1))
        out.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>')
        out.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{relations}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name={quoteattr(t)} sheetId="{n}" r:id="rId{n}"/>' for n, t in enumerate(sheet_titles(titles), 1))
        out.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{relations}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{n}" Type="{relations}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, count + 1))
        out.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{links}<Relationship Id="rId{count + 1}" Type="{relations}/styles" Target="styles.xml"/></Relationships>')
        out.writestr("xl/styles.xml", styles)
