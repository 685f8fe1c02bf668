"""Plain versions of the problems for language-model data, written for clarity, to compare with."""

import re


def boundaries(text):
    """Numbers of the lines at natural boundaries."""
    lines = [x[:-1] if x.endswith("\r") and i < last else x for last in [text.count("\n")] for i, x in enumerate(text.split("\n"))]
    out, fence, before_blank = [], None, False
    for i, line in enumerate(lines):
        inside = fence is not None
        if inside:
            m = re.fullmatch(r" {0,3}(`+|~+)[ \t]*", line)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence):
                fence = None
        else:
            m = re.fullmatch(r" {0,3}(`{3,})([^`]*)", line) or re.fullmatch(r" {0,3}(~{3,})(.*)", line, re.S)
            if m:
                fence = m[1]
        blank = not line.strip(" \t") and not inside
        heading = re.match(r" {0,3}#{1,6}([ \t]|$)", line) and not re.match(r" {0,3}#{1,6}\n", line)
        if i == 0 or not inside and line.strip(" \t") and (before_blank or heading):
            out.append(i)
        before_blank = blank
    return out
