"""Text and pictures of PDF files without a library: objects, streams, pages, text operators, and lines by height."""

from __future__ import annotations

import re
import struct
import zlib

from quillmere.sources.office import MIN_SIDE, section

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_TOKEN = re.compile(rb"\s+|%[^\r\n]*|(<<|>>|\[|\]|\{|\})|/([^\s<>\[\](){}/%]*)|<([0-9A-Fa-f\s]*)>|(\()|([^\s<>\[\](){}/%]+)")
LINE = 3.0


class Name(str):
    pass


class Ref(int):
    pass


_ESCAPES = {ord(a): b for a, b in zip("nrtbf", b"\n\r\t\b\f", strict=True)}


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at]
        at += 1
        if c == 92 and at < len(data):
            e = data[at]
            at += 1
            if e in _ESCAPES:
                out.append(_ESCAPES[e])
            elif 48 <= e <= 55:
                digits = re.match(rb"[0-7]{1,3}", data[at - 1 : at + 2]).group()
                out.append(int(digits, 8) & 255)
                at += len(digits) - 1
            elif e not in (10, 13):
                out.append(e)
            continue
        depth += (c == 40) - (c == 41)
        if not depth:
            break
        out.append(c)
    return bytes(out), at


def tokens(data: bytes, at: int = 0):
    """(kind, value, end): kinds are mark, name, string, word."""
    while at < len(data):
        m = _TOKEN.match(data, at)
        if not m:
            at += 1
            continue
        at = m.end()
        mark, name, hexa, paren, word = m.groups()
        if mark:
            yield "mark", mark, at
        elif paren:
            text, at = _string(data, at)
            yield "string", text, at
        elif hexa is not None and m.group().startswith(b"<"):
            digits = re.sub(rb"\s", b"", hexa)
            yield "string", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
        elif word:
            yield "word", word, at
        elif name is not None and m.group().startswith(b"/"):
            yield "name", Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes.fromhex(x.group(1).decode()), name).decode("latin-1")), at


def _value(word: bytes):
    try:
        return float(word) if b"." in word else int(word)
    except ValueError:
        return {b"true": True, b"false": False, b"null": None}.get(word, word)


def parse(data: bytes, at: int = 0) -> tuple[object, int]:
    """(value, end) of the object that begins here; dictionaries, arrays, names, strings, numbers, references."""
    stack: list[list] = [[]]
    end = at
    for kind, x, end in tokens(data, at):
        if kind == "mark":
            if x in (b"<<", b"["):
                stack.append([x])
                continue
            if x in (b">>", b"]") and len(stack) > 1:
                items = stack.pop()[1:]
                x = dict(zip([str(k) for k in items[::2]], items[1::2], strict=False)) if x == b">>" else items
                stack[-1].append(x)
        elif kind == "word" and x == b"R" and len(stack[-1]) >= 2 and isinstance(stack[-1][-2], int):
            number = stack[-1][-2]
            del stack[-1][-2:]
            stack[-1].append(Ref(number))
        elif kind == "word":
            if x in (b"stream", b"endobj"):
                break
            stack[-1].append(_value(x))
        else:
            stack[-1].append(x)
        if len(stack) == 1 and stack[0] and isinstance(stack[0][-1], (dict, list)):
            break
    return (stack[0][-1] if stack[0] else None), end


def _unpredict(data: bytes, predictor: int, columns: int) -> bytes:
    if predictor < 10:
        return data
    out, before, step = bytearray(), bytes(columns), columns + 1
    for s in range(0, len(data) - columns, step):
        kind, row = data[s], bytearray(data[s + 1 : s + step])
        for i in range(columns):
            left, up, corner = (row[i - 1] if i else 0), before[i], (before[i - 1] if i else 0)
            if kind == 4:
                p = left + up - corner
                add = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            else:
                add = (0, left, up, (left + up) // 2)[kind] if kind < 4 else 0
            row[i] = (row[i] + add) & 255
        out += row
        before = bytes(row)
    return bytes(out)


class File:
    def __init__(self, data: bytes):
        if not data.lstrip()[:5] == b"%PDF-":
            raise ValueError("no PDF")
        self.data, self.objects = data, {}
        for m in _OBJECT.finditer(data):
            self.objects[int(m.group(1))] = m.end()
        self.packed: dict[int, tuple[bytes, int]] = {}
        for n in list(self.objects):
            d = self.get(Ref(n))
            if isinstance(d, dict) and d.get("Type") == "ObjStm":
                body = self.stream(Ref(n))
                heads = [int(x) for x in body[: int(self.get(d["First"]))].split()]
                for number, offset in zip(heads[::2], heads[1::2], strict=False):
                    self.packed[number] = (body, int(self.get(d["First"])) + offset)

    def get(self, x):
        """A value with its reference followed."""
        for _ in range(20):
            if not isinstance(x, Ref):
                return x
            if int(x) in self.objects:
                x = parse(self.data, self.objects[int(x)])[0]
            elif int(x) in self.packed:
                x = parse(*self.packed[int(x)])[0]
            else:
                return None
        return None

    def raw(self, ref: Ref) -> bytes:
        at = parse(self.data, self.objects[int(ref)])[1]
        m = re.compile(rb"\s*stream\r?\n").search(self.data, at - 7 if self.data[at - 6 : at] == b"stream" else at)
        if not m:
            return b""
        length = self.get(self.get(ref).get("Length"))
        end = m.end() + length if isinstance(length, int) else -1
        if end < 0 or not self.data[end : end + 16].lstrip().startswith(b"endstream"):
            end = self.data.find(b"endstream", m.end())
        return self.data[m.end() : end]

    def stream(self, ref: Ref) -> bytes:
        d, data = self.get(ref), self.raw(ref)
        filters = self.get(d.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if f == "FlateDecode":
                data = zlib.decompressobj().decompress(data)
                parms = self.get(d.get("DecodeParms")) or {}
                if isinstance(parms, dict) and parms.get("Predictor", 1) >= 10:
                    data = _unpredict(data, parms["Predictor"], (parms.get("Columns", 1) * parms.get("Colors", 1) * parms.get("BitsPerComponent", 8) + 7) // 8)
            elif f == "ASCIIHexDecode":
                data = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", data).decode())
        return data

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with inherited resources."""
        out: list[dict] = []
        everything = [self.get(Ref(n)) for n in sorted({*self.objects, *self.packed})]
        root = next((d for d in everything if isinstance(d, dict) and d.get("Type") == "Catalog"), None)

        def walk(node, resources, depth):
            d = self.get(node)
            if not isinstance(d, dict) or depth > 40:
                return
            resources = d.get("Resources", resources)
            if d.get("Type") == "Page" or "Kids" not in d:
                out.append({**d, "Resources": resources})
                return
            for kid in self.get(d["Kids"]) or []:
                walk(kid, resources, depth + 1)

        if root:
            walk(root.get("Pages"), None, 0)
        return out or [d for d in everything if isinstance(d, dict) and d.get("Type") == "Page"]

    def resource(self, page: dict, kind: str) -> dict:
        resources = self.get(page.get("Resources")) or {}
        return self.get(resources.get(kind)) or {}


def _cmap(data: bytes) -> dict[bytes, str]:
    """Code -> text of a ToUnicode map."""
    table: dict[bytes, str] = {}
    text = lambda b: b.decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        codes = [x for kind, x, _ in tokens(block) if kind == "string"]
        table.update({a: text(b) for a, b in zip(codes[::2], codes[1::2], strict=False)})
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(<[0-9A-Fa-f]+>|\[[^\]]*\])", block):
            lo, hi, size = int(a, 16), int(b, 16), len(a) // 2
            if c.startswith(b"["):
                for i, x in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", c)):
                    table[(lo + i).to_bytes(size, "big")] = text(bytes.fromhex(x.decode()))
            else:
                first = bytes.fromhex(c[1:-1].decode())
                for i in range(min(hi - lo + 1, 65_536)):
                    table[(lo + i).to_bytes(size, "big")] = text((int.from_bytes(first, "big") + i).to_bytes(len(first), "big"))
    return table


def _decode(data: bytes, table: dict[bytes, str] | None) -> str:
    if not table:
        return data.decode("cp1252", "replace")
    size = max(map(len, table))
    return "".join(table.get(data[i : i + size], "") for i in range(0, len(data), size))


def spans(pdf: File, page: dict) -> list[tuple[float, float, str]]:
    """(x, y, text) of every shown string."""
    contents = page.get("Contents")
    refs = [contents] if isinstance(contents, Ref) and not isinstance(pdf.get(contents), list) else pdf.get(contents) or []
    data = b"\n".join(pdf.stream(r) for r in refs if isinstance(r, Ref))
    tables = {}
    for name, font in pdf.resource(page, "Font").items():
        d = pdf.get(font)
        if isinstance(d, dict) and isinstance(d.get("ToUnicode"), Ref):
            tables[name] = _cmap(pdf.stream(d["ToUnicode"]))
    out, stack, array, table = [], [], None, None
    x = y = x0 = y0 = lead = 0.0

    def number(i: int) -> float:
        v = stack[i] if len(stack) >= -i else 0
        return float(v) if isinstance(v, (int, float)) else 0.0

    def show(parts) -> None:
        text = "".join(_decode(p, table) if isinstance(p, bytes) else " " if isinstance(p, (int, float)) and p < -200 else "" for p in parts)
        if text:
            out.append((x, y, text))

    for kind, v, _ in tokens(data):
        if kind == "mark":
            if v == b"[":
                array = []
            elif v == b"]" and array is not None:
                stack.append(array)
                array = None
            continue
        if kind != "word" or isinstance(_value(v), (int, float)):
            (stack if array is None else array).append(v if kind != "word" else _value(v))
            continue
        if v == b"BT":
            x = y = x0 = y0 = 0.0
        elif v == b"Tf" and len(stack) >= 2:
            table = tables.get(str(stack[-2]))
        elif v in (b"Td", b"TD"):
            lead = -number(-1) if v == b"TD" else lead
            x0, y0 = x0 + number(-2), y0 + number(-1)
            x, y = x0, y0
        elif v == b"Tm":
            x = x0 = number(-2)
            y = y0 = number(-1)
        elif v == b"TL":
            lead = number(-1)
        elif v in (b"T*", b"'", b'"'):
            y0 -= lead
            x, y = x0, y0
        if v in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytes):
            show([stack[-1]])
        elif v == b"TJ" and stack and isinstance(stack[-1], list):
            show(stack[-1])
        stack = []
    return out


def page_text(found: list[tuple[float, float, str]]) -> str:
    """Lines from the top: strings whose heights differ by at most ``LINE`` are one line."""
    rows: list[list] = []
    for x, y, text in found:
        row = next((r for r in rows if abs(r[0] - y) <= LINE), None)
        if row is None:
            rows.append([y, [text]])
        else:
            row[1].append(text)
    rows.sort(key=lambda r: -r[0])
    return "\n".join("".join(r[1]) for r in rows)


_HEADING = re.compile(r"(?i)^(?:anexo|annexe|article|artigo|capitulo|capítulo|chapitre|chapter|part|partie|seccion|secao|section|sección|seção) ")
_FIGURE = re.compile(r"(?i)^(?:cuadro|figura|figure|graphique|gráfico|quadro|tabela|tabla|tableau) [0-9]")


def is_heading(line: str) -> bool:
    size = len(line.encode())
    if 2 < size < 100 and line == line.upper():
        return True
    return 0 < size < 120 and bool((line[0].isdigit() and "." in line[:10]) or _HEADING.match(line) or _FIGURE.match(line))


def heading_level(line: str) -> int:
    return line.split(" ")[0].count(".") or (1 if line == line.upper() else 2)


def section_type(heading: str, content: str) -> str:
    from quillmere.operators.rules import REQUIREMENT_WORDS

    h, c = heading.lower(), content.lower()
    if any(w in h for w in ("definition", "definición", "glosario", "glossary")) or any(w in c for w in ("definition", "definición")):
        return "definition"
    if any(w in h or w in c for w in REQUIREMENT_WORDS):
        return "requirement"
    if "table" in h or "tabla" in h or content.count("\t") > 3 or content.count("|") > 3:
        return "table"
    return "annex" if "anexo" in h or "annex" in h else "section"


def page_sections(text: str, page: int) -> list[dict]:
    """A page cut at its headings; a heading without text joins the deeper one behind it."""
    blocks: list[tuple[str, list[str]]] = [("", [])]
    for line in (x.strip() for x in text.split("\n")):
        if line and is_heading(line):
            blocks.append((line, []))
        elif line or blocks[-1][1]:
            blocks[-1][1].append(line)
    out = []
    for heading, lines in blocks:
        content = "\n".join(lines).strip()
        if heading or content:
            out.append(section(heading, content, heading_level(heading) if heading else 0, page, section_type(heading, content)))
    for a, b in reversed(list(zip(range(len(out) - 1), range(1, len(out)), strict=True))):
        above, below = out[a], out[b]
        if above["heading"] and not above["content"] and below["level"] > above["level"]:
            below["heading"] = f"{above['heading']} — {below['heading']}" if below["heading"] else above["heading"]
            below["level"] = above["level"]
            del out[a]
    return out or ([section("", text, 0, page, "paragraph")] if text.strip() else [])


def _png(width: int, height: int, kind: int, rows: list[bytes]) -> bytes:
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b"")


def page_images(pdf: File, page: dict, number: int, index: int) -> list[dict]:
    """Pictures of a page: JPEG as it is, deflated grey, RGB and CMYK as PNG; masks and tiny ones are left out."""
    out = []
    for ref in pdf.resource(page, "XObject").values():
        d = pdf.get(ref)
        if not isinstance(d, dict) or d.get("Subtype") != "Image" or pdf.get(d.get("ImageMask")):
            continue
        w, h = (pdf.get(d.get(k)) or 0 for k in ("Width", "Height"))
        filters = pdf.get(d.get("Filter")) or []
        kinds = filters if isinstance(filters, list) else [filters]
        if w < MIN_SIDE or h < MIN_SIDE:
            continue
        if kinds and kinds[-1] == "DCTDecode":
            out.append({"section_idx": index, "page_number": number, "mime": "image/jpeg", "width": w, "height": h, "data": pdf.raw(ref)})
        elif kinds == ["FlateDecode"] and pdf.get(d.get("BitsPerComponent")) == 8:
            space = pdf.get(d.get("ColorSpace"))
            n = {"DeviceGray": 1, "DeviceRGB": 3, "DeviceCMYK": 4}.get(space if isinstance(space, str) else "")
            data = pdf.stream(ref)
            if n is None or len(data) < w * h * n:
                continue
            if n == 4:
                data, n = bytes((255 - data[i + c]) * (255 - data[i + 3]) // 255 for i in range(0, w * h * 4, 4) for c in range(3)), 3
            out.append({"section_idx": index, "page_number": number, "mime": "image/png", "width": w, "height": h, "data": _png(w, h, 0 if n == 1 else 2, [data[i * w * n : (i + 1) * w * n] for i in range(h)])})
    return out


def read(data: bytes, name: str = "") -> tuple[list[dict], list[dict]]:
    """Sections page by page; a page that can't be read is left out, and a file without text gets one section that says so."""
    pdf = File(data)
    out, images = [], []
    for number, page in enumerate(pdf.pages(), 1):
        try:
            images += page_images(pdf, page, number, len(out))
            out += page_sections(page_text(spans(pdf, page)), number)
        except (ValueError, KeyError, IndexError, TypeError, AttributeError, zlib.error):
            continue
    return out or [section(name, "This file has no text that could be read.", 1, 1, "paragraph")], images
