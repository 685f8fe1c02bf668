"""Edits of one note: sections, frontmatter fields, table rows. Pure functions from text to text.

An edit that can't be applied raises PatchError with a code; patch() applies a list of edits, all or none if strict.
"""

from __future__ import annotations

import json
import re

import yaml

from vaultspark.parse import markdown as md


class PatchError(ValueError):
    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code


def _key(title: str) -> str:
    return re.sub(r"^#{1,6}\s+", "", title.strip()).strip().lower()


def find_section(lines: list[str], heading: str, occurrence: int | None = None) -> tuple[int, int]:
    """(heading line, end) of the section with that title; marks before the title ask for its level. Of several, the occurrence from 1."""
    m = re.match(r"(#{1,6})\s+", heading.strip())
    marks = md.headings(lines)
    hits = [k for k, (_, level, title) in enumerate(marks) if _key(title) == _key(heading) and (not m or level == len(m[1]))]
    if not hits:
        raise PatchError("anchor_not_found", f"no heading {heading!r}")
    if len(hits) > 1 and occurrence is None:
        raise PatchError("anchor_ambiguous", f"{len(hits)} headings {heading!r}")
    if not 1 <= (occurrence or 1) <= len(hits):
        raise PatchError("anchor_not_found", f"heading {heading!r} occurs {len(hits)} times")
    line, level, _ = marks[hits[(occurrence or 1) - 1]]
    end = next((at for at, other, _ in marks if at > line and other <= level), len(lines))
    return line, end


def _steps(field: str) -> list:
    steps, at = [], re.compile(r"([A-Za-z_]\w*)|(\d+)|\[([A-Za-z_]\w*)=([^\]]+)\]", re.ASCII)
    rest = field.strip()
    while rest:
        m = at.match(rest)
        if not m:
            raise PatchError("invalid_op", f"not a field path: {field!r}")
        steps.append(m[1] if m[1] else int(m[2]) if m[2] else (m[3], m[4]))
        rest = rest[m.end() :].removeprefix(".") if not rest[m.end() :].startswith("[") else rest[m.end() :]
    if not steps:
        raise PatchError("invalid_op", "empty field path")
    return steps


def _pick(value, step, create: bool):
    """What a step leads to; with create, missing maps come into being."""
    if isinstance(step, tuple):
        found = [x for x in value if isinstance(x, dict) and str(x.get(step[0])).strip().lower() == step[1].strip().lower()] if isinstance(value, list) else []
        if len(found) != 1:
            raise PatchError("anchor_ambiguous" if found else "anchor_not_found", f"{len(found)} elements with {step[0]}={step[1]}")
        return found[0]
    if isinstance(step, int):
        if not isinstance(value, list) or step >= len(value):
            raise PatchError("anchor_not_found", f"no element {step}")
        return value[step]
    if not isinstance(value, dict):
        raise PatchError("anchor_not_found", f"{step!r} is asked of a value without fields")
    if step not in value and create:
        value[step] = {}
    if step not in value:
        raise PatchError("anchor_not_found", f"no field {step!r}")
    return value[step]


def set_field(data: dict, field: str, value) -> None:
    *way, last = _steps(field)
    for s in way:
        data = _pick(data, s, True)
    if isinstance(last, tuple):
        found = _pick(data, last, False)
        if not isinstance(value, dict):
            raise PatchError("invalid_op", "an element is replaced by a map only")
        found.clear()
        found.update(value)
    elif isinstance(last, int):
        _pick(data, last, False)
        data[last] = value
    elif isinstance(data, dict):
        data[last] = value
    else:
        raise PatchError("anchor_not_found", f"{last!r} is asked of a value without fields")


def delete_field(data: dict, field: str) -> None:
    *way, last = _steps(field)
    for s in way:
        data = _pick(data, s, False)
    gone = _pick(data, last, False)
    if isinstance(last, tuple):
        data[:] = [x for x in data if x is not gone]
    else:
        del data[last]


def _field_edit(text: str, op: dict, whole: bool) -> str:
    raw, at = (text, len(text)) if whole else md.fence(text)
    data = md.load_yaml(raw) if raw and raw.strip() else {}
    if data is None:
        raise PatchError("invalid_frontmatter", "frontmatter is no mapping")
    (delete_field(data, op["field"]) if op["op"] == "delete_field" else set_field(data, op["field"], op.get("value")))
    dumped = yaml.safe_dump(data, sort_keys=False, allow_unicode=True) if data else ""
    return dumped if whole else f"---\n{dumped}---\n{text[at:]}"


def _scope(lines: list[str], op: dict, base: int) -> tuple[int, int]:
    if not op.get("heading"):
        return 0, len(lines)
    return find_section(lines, op["heading"], op.get("occurrence"))


def _text_edit(text: str, op: dict) -> str:
    _, at = md.fence(text)
    head, lines = text[:at], text[at:].split("\n")
    kind, new = op["op"], (op.get("text") or "").rstrip("\n")
    if kind == "append_eof" or kind == "append" and not op.get("heading") and op.get("position") != "start":
        return head + "\n".join(lines).rstrip("\n") + ("\n\n" if text[at:].strip() else "") + new + "\n"
    start, end = _scope(lines, op, 0)
    if kind == "replace_text":
        old, count = op.get("old") or "", op.get("count") or 1
        part = "\n".join(lines[start:end])
        if not old or old not in part:
            raise PatchError("text_not_found", "the text to replace is not there")
        if part.count(old) > count and not op.get("count"):
            raise PatchError("text_ambiguous", f"the text occurs {part.count(old)} times")
        return head + "\n".join([*lines[:start], *part.replace(old, op.get("new") or "", count).split("\n"), *lines[end:]])
    if kind == "replace_section":
        first = [] if re.match(r"#{1,6}\s", new) else [lines[start]]
        return head + "\n".join([*lines[:start], *first, *new.split("\n"), "", *lines[end:]])
    if kind == "prepend" or kind == "append" and op.get("position") == "start":
        at_line = start + 1 if op.get("heading") else start
        return head + "\n".join([*lines[:at_line], *new.split("\n"), *lines[at_line:]])
    if kind == "append":
        while end > start + 1 and not lines[end - 1].strip():
            end -= 1
        return head + "\n".join([*lines[:end], *new.split("\n"), *([""] if end < len(lines) and lines[end].strip() else []), *lines[end:]])
    raise PatchError("invalid_op", f"unknown edit {kind!r}")


def _column(heads: list[str], name: str) -> int:
    found = [i for i, h in enumerate(heads) if md.header_key(h) == md.header_key(name)]
    if len(found) != 1:
        raise PatchError("column_ambiguous" if found else "column_not_found", name)
    return found[0]


def _table_edit(text: str, op: dict) -> str:
    _, at = md.fence(text)
    lines = text[at:].split("\n")
    found = md.tables(lines)
    if op.get("heading"):
        a, b = find_section(lines, op["heading"], op.get("occurrence"))
        found = [t for t in found if a <= t["start"] < b]
    if op.get("table") is None and len(found) > 1:
        raise PatchError("table_ambiguous", f"{len(found)} tables")
    if not found or (op.get("table") or 0) >= len(found):
        raise PatchError("table_not_found")
    t = found[op.get("table") or 0]
    heads, rows, aligns = list(t["headers"]), [list(r) for r in t["rows"]], list(t["aligns"])
    keys = lambda: [md.row_key(heads, r, i, op.get("key_column")) for i, r in enumerate(rows)]

    def row_at() -> int:
        hits = [i for i, k in enumerate(keys()) if k == op["row_key"]]
        if len(hits) != 1:
            raise PatchError("row_ambiguous" if hits else "row_not_found", str(op["row_key"]))
        if op.get("expected_row_hash") and op["expected_row_hash"] != md.row_hash(rows[hits[0]]):
            raise PatchError("stale_row", str(op["row_key"]))
        return hits[0]

    as_row = lambda values: [str({md.header_key(k): v for k, v in values.items()}.get(md.header_key(h), "")) for h in heads] if isinstance(values, dict) else (list(map(str, values)) + [""] * len(heads))[: len(heads)]
    kind = op["op"]
    if kind == "update_cell":
        rows[row_at()][_column(heads, op["column"])] = str(op["value"])
    elif kind == "update_row":
        i = row_at()
        for k, v in op["values"].items():
            rows[i][_column(heads, k)] = str(v)
    elif kind == "delete_row":
        del rows[row_at()]
    elif kind == "append_row":
        rows.append(as_row(op["values"]))
    elif kind == "replace_table":
        new = [as_row(r) for r in op["rows"]]
        mode = op.get("mode", "replace")
        if mode == "append":
            rows += new
        elif mode == "upsert":
            at_key = {k: i for i, k in enumerate(keys())}
            for i, r in enumerate(new):  # of several new rows of a key the last counts
                k = md.row_key(heads, r, len(rows) + i, op.get("key_column"))
                if k in at_key:
                    rows[at_key[k]] = r
                else:
                    at_key[k] = len(rows)
                    rows.append(r)
        else:
            rows = new
    elif kind == "alter_table_schema":
        if not op.get("confirm"):
            raise PatchError("confirm_required")
        for old, new in (op.get("rename") or {}).items():
            heads[_column(heads, old)] = new
        for name in op.get("drop") or []:
            i = _column(heads, name)
            for r in [heads, aligns, *rows]:
                del r[i : i + 1]
        for name in op.get("add") or []:
            heads.append(name)
            aligns.append("")
            for r in rows:
                r.append("")
    else:
        raise PatchError("invalid_op", f"unknown edit {kind!r}")
    return text[:at] + "\n".join([*lines[: t["start"]], *md.render_table(heads, rows, aligns).split("\n"), *lines[t["end"] + 1 :]])


_TABLE_OPS = {"update_cell", "update_row", "delete_row", "append_row", "replace_table", "alter_table_schema"}


def apply_op(text: str, op: dict, path: str = "") -> str:
    kind, whole = op.get("op"), path.lower().endswith((".yaml", ".yml"))
    if kind in ("set_field", "delete_field"):
        return _field_edit(text, op, whole)
    if whole:
        raise PatchError("invalid_op", "a YAML note knows field edits only")
    return _table_edit(text, op) if kind in _TABLE_OPS else _text_edit(text, op)


def patch(text: str, ops: list[dict], strict: bool = True, path: str = "") -> tuple[str, list[str]]:
    """(text, result per edit: 'ok' or a code). If strict, one failure leaves the text as it was."""
    now, results = text, []
    for op in ops:
        try:
            now = apply_op(now, op, path)
            results.append("ok")
        except PatchError as e:
            results.append(e.code)
        except (KeyError, TypeError, AttributeError):
            results.append("invalid_op")
    return (text if strict and any(r != "ok" for r in results) else now), results


def patch_json(text: str | None, ops: str | None, strict: bool = True, path: str = "") -> tuple[str | None, list[str]]:
    if text is None:
        return None, []
    try:
        listed = json.loads(ops) if ops else []
    except ValueError:
        return text, ["invalid_op"]
    return patch(text, listed if isinstance(listed, list) else [listed], strict, path)
