"""Word, PowerPoint and Excel files by zip and XML alone."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import xml.etree.ElementTree as ET
import zipfile

MIN_SIDE = 32
MIME = {"bmp": "image/bmp", "gif": "image/gif", "jpeg": "image/jpeg", "jpg": "image/jpeg", "png": "image/png", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp"}


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def named(node, name: str):
    """Descendants by local name, in order."""
    return (x for x in node.iter() if local(x.tag) == name)


def attribute(node, name: str) -> str:
    return next((v for k, v in node.attrib.items() if local(k) == name), "")


def section(heading="", content="", level=1, page=0, kind="section", **metadata) -> dict:
    return {"heading": heading, "content": content, "level": level, "page_number": page, "section_type": kind, "metadata": {k: str(v) for k, v in metadata.items()}}


def image_size(data: bytes) -> tuple[int, int]:
    """(width, height) by the header of a PNG, GIF, BMP or JPEG; (0, 0) where it doesn't tell."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:3] == b"GIF" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return abs(w), abs(h)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            mark = data[at + 1]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 if mark == 0xFF or 0xD0 <= mark <= 0xD9 or mark == 1 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return 0, 0


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Relation id -> path within the archive."""
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    return {r.get("Id", ""): posixpath.normpath(posixpath.join(folder, r.get("Target", ""))).lstrip("/") if not r.get("Target", "").startswith("/") else r.get("Target", "")[1:] for r in ET.fromstring(z.read(rels))}


def _images(z: zipfile.ZipFile, node, relations: dict[str, str], index: int, page: int) -> list[dict]:
    """Embedded pictures below a node; tiny ones and unknown kinds are left out."""
    out = []
    for blip in named(node, "blip"):
        path = relations.get(attribute(blip, "embed"), "")
        mime = MIME.get(path.rpartition(".")[2].lower())
        if not mime or path not in z.namelist():
            continue
        data = z.read(path)
        w, h = image_size(data)
        if (w or h) and (w < MIN_SIDE or h < MIN_SIDE):
            continue
        out.append({"section_idx": index, "page_number": page, "mime": mime, "width": w, "height": h, "data": data})
    return out


def _paragraph(node) -> str:
    out = []
    for x in node.iter():
        name = local(x.tag)
        if name == "t":
            out.append(x.text or "")
        elif name == "tab":
            out.append("\t")
        elif name in ("br", "cr"):
            out.append("\n")
    return "".join(out)


def _rows(table, row: str, cell: str) -> str:
    return "\n".join("| " + " | ".join(" ".join(_paragraph(c).split()) for c in r if local(c.tag) == cell) + " |" for r in named(table, row))


def docx(data: bytes, name: str = "") -> tuple[list[dict], list[dict]]:
    """Sections by styles that begin with ``heading`` or ``title``. All tables stand behind the headed sections and before the last one; a last heading without text goes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        part = "word/document.xml"
        body = next(named(ET.fromstring(z.read(part)), "body"))
        relations = _relations(z, part)
        headed, tables, images, lines, heading, level = [], [], [], [], "", 1
        for node in body:
            if local(node.tag) == "tbl":
                tables.append(section(heading, _rows(node, "tr", "tc"), level, 0, "table"))
                continue
            if local(node.tag) != "p":
                continue
            style = next((attribute(s, "val") for s in named(node, "pStyle")), "").lower()
            text = _paragraph(node).strip()
            if style.startswith(("heading", "title")) and text:
                if lines or heading:
                    headed.append(section(heading, "\n".join(lines), level))
                digits = re.search(r"\d", style)
                heading, level, lines = text, int(digits.group()) if digits else 1, []
            elif text:
                lines.append(text)
            images += _images(z, node, relations, len(headed), 0)
        last = [section(heading, "\n".join(lines), level)] if lines else []
        return headed + tables + last, images


def pptx(data: bytes, name: str = "") -> tuple[list[dict], list[dict]]:
    """One section a slide that has text, slides in numeric order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((int(m.group(1)), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        out, images = [], []
        for number, part in slides:
            root = ET.fromstring(z.read(part))
            text = "\n".join(t for t in (_paragraph(p).strip() for p in named(root, "p")) if t)
            images += _images(z, root, _relations(z, part), len(out), number)
            if text:
                out.append(section(f"Slide {number}", text, 1, number))
        return out, images


def xlsx(data: bytes, name: str = "") -> tuple[list[dict], list[dict]]:
    """One table a sheet that has rows; a workbook without any is an error."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [_paragraph(s) for s in ET.fromstring(z.read("xl/sharedStrings.xml")) if local(s.tag) == "si"] if "xl/sharedStrings.xml" in names else []
        book, relations = ET.fromstring(z.read("xl/workbook.xml")), _relations(z, "xl/workbook.xml")
        out = []
        for sheet in named(book, "sheet"):
            part = relations.get(next((v for k, v in sheet.attrib.items() if k.endswith("}id")), ""), "")
            if part not in names:
                continue
            rows = []
            for row in named(ET.fromstring(z.read(part)), "row"):
                cells: list[str] = []
                for c in (x for x in row if local(x.tag) == "c"):
                    at = 0
                    for ch in re.match(r"[A-Z]*", c.get("r", "")).group():
                        at = at * 26 + ord(ch) - 64
                    cells += [""] * (at - 1 - len(cells))
                    value = next((v.text or "" for v in named(c, "v")), "")
                    kind = c.get("t", "")
                    cells.append(shared[int(value)] if kind == "s" and value else _paragraph(c) if kind == "inlineStr" else value)
                if any(cells):
                    rows.append("| " + " | ".join(cells) + " |")
            if rows:
                title = sheet.get("name", "")
                out.append(section(title, "\n".join(rows), 1, 0, "table", sheet_name=title, row_count=len(rows)))
    if not out:
        raise ValueError("no sheet has data")
    return out, []
