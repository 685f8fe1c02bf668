"""Markdown notes: frontmatter, sections, tables, fenced diagrams, chunks."""

from __future__ import annotations

import csv
import difflib
import hashlib
import io
import json
import re
from bisect import bisect_right

import yaml

SEPARATOR = " › "
_FENCED = re.compile(r"\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", re.S)
_EMPTY = re.compile(r"\A---\r?\n---[ \t]*(?:\r?\n|\Z)")
_ATX = re.compile(r"(#{1,6})\s+(.*)")
_RULE_CELL = re.compile(r":?-+:?")


class _Loader(yaml.SafeLoader):
    """Dates that are none stay texts."""


def _timestamp(loader, node):
    try:
        return yaml.SafeLoader.construct_yaml_timestamp(loader, node)
    except (ValueError, OverflowError):
        return loader.construct_scalar(node)


_Loader.add_constructor("tag:yaml.org,2002:timestamp", _timestamp)


def load_yaml(text: str) -> dict | None:
    """A mapping; None for anything else, errors included."""
    try:
        value = yaml.load(text, Loader=_Loader)
    except (yaml.YAMLError, ValueError, OverflowError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def fence(text: str) -> tuple[str | None, int]:
    """(YAML between the fences, its end): (None, 0) without frontmatter."""
    m = _EMPTY.match(text)
    if m:
        return "", m.end()
    m = _FENCED.match(text)
    return (m[1], m.end()) if m else (None, 0)


def frontmatter_json(text: str | None, path: str = "") -> str | None:
    """The catalog entry of a note: JSON of its frontmatter, {} for an empty or broken one, None for a note without.

    A YAML note is frontmatter as a whole, and None if it is no mapping. Dates become texts.
    """
    if text is None:
        return None
    if path.lower().endswith((".yaml", ".yml")):
        value = load_yaml(text) if text.strip() else {}
        return None if value is None else json.dumps(value, default=str)
    raw, _ = fence(text)
    return None if raw is None else json.dumps(load_yaml(raw) or {}, default=str)


def content_hash(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()


def chunk_id(source: str, start: int, end: int, digest: str, model: str) -> str:
    return hashlib.sha256(f"markdown:{source}:{start}:{end}:{digest}:{model}".encode("utf-8", "replace")).hexdigest()[:16]


def outside_fences(lines: list[str]):
    """(number, line) of the lines outside code fences; a fence closes with the sign it opened with."""
    sign = None
    for i, line in enumerate(lines):
        mark = line.lstrip()[:3]
        if mark in ("```", "~~~"):
            if sign is None:
                sign = mark
            elif sign == mark:
                sign = None
        elif sign is None:
            yield i, line


def headings(lines: list[str]) -> list[tuple[int, int, str]]:
    """(line, level, title) of every ATX heading outside fences."""
    return [(i, len(m[1]), m[2].strip()) for i, line in outside_fences(lines) if (m := _ATX.match(line))]


def sections(text: str) -> list[dict]:
    """Sections by heading: each runs to the next heading of its level or a higher one, so it holds its subsections.

    What comes before the first heading is a section of level 0. Lines count from 1 over the whole note, frontmatter included.
    Blank sections and blank notes have no rows. One backward pass over the headings finds all ends.
    """
    _, at = fence(text)
    body, base = text[at:], text.count("\n", 0, at) + 1
    if not body.strip():
        return []
    lines = body.split("\n")
    marks = headings(lines)
    ends, nearest = [0] * len(marks), [len(lines)] * 7
    for k in range(len(marks) - 1, -1, -1):
        line, level, _ = marks[k]
        ends[k] = min(nearest[1 : level + 1])
        nearest[level] = line
    spans = [(0, marks[0][0] if marks else len(lines), 0, "")] if not marks or marks[0][0] > 0 else []
    trail: list[tuple[int, str]] = []
    for (line, level, title), end in zip(marks, ends):
        while trail and trail[-1][0] >= level:
            trail.pop()
        trail.append((level, title))
        spans.append((line, end, level, SEPARATOR.join(t for _, t in trail)))
    rows = []
    for start, end, level, crumbs in spans:
        part = "\n".join(lines[start:end]).strip()
        if part:
            rows.append({"heading": crumbs, "level": level, "text": part, "start_line": base + start, "end_line": base + max(end - 1, start)})
    return rows


def cells(line: str) -> list[str]:
    """Cells of a table row; an escaped pipe belongs to its cell."""
    s = line.strip()
    s = s[1:] if s.startswith("|") else s
    s = s[:-1] if s.endswith("|") and not s.endswith("\\|") else s
    out = [""]
    for m in re.finditer(r"\\.|\||[^|\\]+|\\\Z", s, re.S):
        if m[0] == "|":
            out.append("")
        else:
            out[-1] += "|" if m[0] == "\\|" else m[0]
    return [c.strip() for c in out]


def _is_rule(line: str) -> bool:
    return ("|" in line or "-" in line) and all(_RULE_CELL.fullmatch(c) for c in cells(line))


def tables(lines: list[str]) -> list[dict]:
    """GFM tables outside fences: headers, rows (padded or cut to the headers), alignments, first and last line from 0, number."""
    free = dict(outside_fences(lines))
    found, i = [], 0
    while i < len(lines):
        if i in free and "|" in free[i] and i + 1 < len(lines) and _is_rule(lines[i + 1]):
            head, j = cells(lines[i]), i + 2
            rows = []
            while j < len(lines) and "|" in lines[j] and lines[j].strip():
                row = cells(lines[j])
                rows.append((row + [""] * len(head))[: len(head)])
                j += 1
            side = lambda c: {(True, True): "center", (False, True): "right", (True, False): "left"}.get((c.startswith(":"), c.endswith(":")), "")
            found.append({"headers": head, "rows": rows, "aligns": [side(c) for c in cells(lines[i + 1])], "start": i, "end": j - 1, "number": len(found)})
            i = j
        else:
            i += 1
    return found


def render_table(headers: list[str], rows: list[list[str]], aligns: list[str] | None = None) -> str:
    """A GFM table, with pipes, backslashes and line ends in cells escaped."""
    esc = lambda v: str(v).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ").strip()
    rule = {"center": ":---:", "right": "---:", "left": ":---"}
    line = lambda row: "| " + " | ".join(row) + " |"
    given = list(aligns or []) + [""] * len(headers)
    return "\n".join([line(map(esc, headers)), line([rule.get(a, "---") for a in given[: len(headers)]]), *[line([esc(c) for c in (list(r) + [""] * len(headers))[: len(headers)]]) for r in rows]])


def read_csv(text: str) -> tuple[list[str], list[list[str]]]:
    """(headers, rows): blank rows left out, short rows padded, long ones cut."""
    rows = [r for r in csv.reader(io.StringIO(text)) if any(c.strip() for c in r)]
    if not rows:
        return [], []
    return rows[0], [(r + [""] * len(rows[0]))[: len(rows[0])] for r in rows[1:]]


def write_csv(headers: list[str], rows: list[list[str]]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([headers, *rows])
    return out.getvalue()


def read_json_table(text: str) -> tuple[list[str], list[list[str]]]:
    """A table from a list of objects (columns in order of first use) or from {headers, rows}. Anything else is a ValueError."""
    data = json.loads(text)
    if isinstance(data, dict) and isinstance(data.get("headers"), list):
        return [str(h) for h in data["headers"]], [["" if c is None else str(c) for c in r] for r in data.get("rows") or []]
    if isinstance(data, list) and all(isinstance(r, dict) for r in data):
        heads = list(dict.fromkeys(k for r in data for k in r))
        return heads, [["" if r.get(h) is None else str(r[h]) for h in heads] for r in data]
    raise ValueError("neither a list of objects nor {headers, rows}")


def header_key(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def fuzzy_headers(incoming: list[str], existing: list[str], cutoff: float = 0.72, margin: float = 0.08) -> dict[str, str | None]:
    """Each incoming header's existing one: equal keys, else the most similar if it is similar enough and clearly the best, else None."""
    known = {header_key(h): h for h in existing}
    out: dict[str, str | None] = {}
    for h in incoming:
        k = header_key(h)
        rated = sorted(((difflib.SequenceMatcher(None, k, e).ratio(), e) for e in known), reverse=True)
        sure = rated and rated[0][0] >= cutoff and rated[0][0] - (rated[1][0] if len(rated) > 1 else 0.0) >= margin
        out[h] = known.get(k) or (known[rated[0][1]] if sure else None)
    return out


def row_key(headers: list[str], row: list[str], number: int, column: str | None = None) -> str:
    """A row's natural key: the key column's cell, else the first cell that isn't blank, else its number."""
    if column:
        for h, c in zip(headers, row):
            if header_key(h) == header_key(column) and c.strip():
                return c.strip()
    return next((c.strip() for c in row if c.strip()), f"row-{number}")


def row_hash(row: list[str]) -> str:
    return content_hash("\x00".join(c.strip() for c in row))


def schema_hash(headers: list[str]) -> str:
    return content_hash("\x00".join(map(header_key, headers)))


def flat_row(crumbs: list[str], headers: list[str], row: list[str]) -> str:
    pairs = [(h.strip(), c.strip()) for h, c in zip(headers, row)]
    line = ", ".join(f"{h}: {c}" if h else c for h, c in pairs if h or c)
    head = " > ".join(c for c in crumbs if c)
    return " — ".join(x for x in (head, line) if x)


def flat_headers(crumbs: list[str], headers: list[str]) -> str:
    head = " > ".join(c for c in crumbs if c)
    line = "Columns: " + ", ".join(h.strip() for h in headers if h.strip())
    return f"{head} — {line}" if head else line


def collapse_tables(text: str) -> str:
    """Each table as one line that names its size and columns."""
    lines = text.split("\n")
    for t in reversed(tables(lines)):
        n, names = len(t["rows"]), ", ".join(h.strip() for h in t["headers"] if h.strip())
        lines[t["start"] : t["end"] + 1] = [f"[table: {n} row{'' if n == 1 else 's'} — {names}]"]
    return "\n".join(lines)


def diagram_blocks(lines: list[str]) -> list[tuple[int, str]]:
    """(first line of the content from 0, text) of fenced mermaid blocks; an open one at the end is none."""
    found, start, sign = [], None, ""
    for i, line in enumerate(lines):
        s = line.lstrip()
        if start is None:
            if re.match(r"(?:```+|~~~+)\s*mermaid\b", s, re.I):
                start, sign = i + 1, s[:3]
        elif s[:3] == sign:
            found.append((start, "\n".join(lines[start:i])))
            start = None
    return found


def note_title(text: str, path: str) -> str:
    raw, _ = fence(text)
    given = (load_yaml(raw) or {}).get("title") if raw else None
    if isinstance(given, str) and given.strip():
        return given.strip()
    return re.sub(r"\.(?:md|markdown|yaml|yml|mmd)$", "", path.rsplit("/", 1)[-1], flags=re.I).replace("-", " ").replace("_", " ").strip()


def chunks(text: str | None, path: str, model: str = "", key_column: str | None = None) -> list[dict]:
    """All chunks of a note in order: its sections, then each table's header and rows, then each diagram's parts.

    Tables and diagrams stay inside their section's text and name it as their parent: the last section around them.
    """
    from vaultspark.parse import mermaid

    if text is None:
        return []
    low = path.lower()
    rows: list[dict] = []

    def add(scheme: str, kind: str, heading: str, level: int, body: str, start: int, end: int, **more) -> str:
        digest = content_hash(body)
        own = chunk_id(f"{scheme}:{path}", start, end, digest, model)
        base = {"path": path, "ord": len(rows), "heading": heading, "text": body, "start_line": start, "end_line": end, "heading_level": level, "chunk_hash": own, "content_hash": digest, "section_bytes": len(body.encode("utf-8", "replace")), "chunk_kind": kind}
        rows.append(base | {"parent_chunk_hash": "", "table_id": "", "table_schema_hash": "", "row_index": None, "row_key": ""} | more)
        return own

    if low.endswith((".yaml", ".yml")):
        data = load_yaml(text) or {}
        parts = [str(data[k]).strip() for k in ("title", "description", "summary", "okf_type", "status", "resource") if data.get(k) not in (None, "")]
        add("yaml", "section", "", 0, "\n".join(parts) or note_title("", path), 1, text.count("\n") + 1)
        return rows
    if low.endswith(".mmd"):
        for part in mermaid.parts(text, [note_title("", path).title()]):
            add("mmd", part["kind"], part["heading"], 0, part["text"], part["line"] + 1, part["line"] + 1, row_key=part["key"])
        return rows

    parents = [(s["start_line"], s["end_line"], s["heading"], add("markdown", "section", s["heading"], s["level"], s["text"], s["start_line"], s["end_line"])) for s in sections(text)]
    _, at = fence(text)
    lines, base, title = text[at:].split("\n"), text.count("\n", 0, at) + 1, note_title(text, path)

    starts = [p[0] for p in parents]

    def owner(line: int) -> tuple[str, str]:
        for k in range(bisect_right(starts, line) - 1, -1, -1):
            if parents[k][1] >= line:
                return parents[k][2], parents[k][3]
        return "", ""

    for t in tables(lines):
        first = base + t["start"]
        heading, parent = owner(first)
        crumbs = [title, *[c for c in heading.split(SEPARATOR) if c]]
        ids = {"parent_chunk_hash": parent, "table_id": content_hash(f"{path}:{first}:{t['number']}"), "table_schema_hash": schema_hash(t["headers"])}
        add("markdown", "table_header", heading, 0, flat_headers(crumbs, t["headers"]), first, first + 1, **ids)
        for n, row in enumerate(t["rows"]):
            add("markdown", "table_row", heading, 0, flat_row(crumbs, t["headers"], row), first + 2 + n, first + 2 + n, row_index=n, row_key=row_key(t["headers"], row, n, key_column), **ids)
    for start, body in diagram_blocks(lines):
        heading, parent = owner(base + start)
        for part in mermaid.parts(body, [title, *[c for c in heading.split(SEPARATOR) if c]]):
            add("markdown", part["kind"], heading, 0, part["text"], base + start + part["line"], base + start + part["line"], parent_chunk_hash=parent, row_key=part["key"])
    return rows
