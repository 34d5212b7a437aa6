"""Line-by-line Python models, as a second opinion on the array expressions."""

import re


def comment_lines(lines):
    out, block = [], False
    for line in lines:
        body = line.strip()
        if block:
            out.append(True)
            block = "*/" not in body
        elif body.startswith("/*"):
            out.append(True)
            block = "*/" not in body
        else:
            out.append(body.startswith(("//", "#", "--", ";;")))
    return out


def none_near(lines, i, pattern, k=10):
    return not any(re.search(pattern, lines[j]) for j in range(max(0, i - k), min(len(lines), i + k + 1)))


def inside(lines, i, pattern):
    for j in range(i - 1, -1, -1):
        if re.search(pattern, lines[j]):
            return True
        if not lines[j].strip() and j + 5 < i:
            return False
    return False


def used_after_free(lines, i, pointer):
    depth = len(lines[i]) - len(lines[i].lstrip())
    for line in lines[i + 1:]:
        body = line.strip()
        if not body:
            continue
        if len(line) - len(body) <= depth and (body == "}" or body.startswith(
                ("return", "void ", "int ", "static ", "char ", "struct "))):
            return False
        if pointer in body and any(m in body for m in ("= NULL", "= nullptr", "= 0")):
            return False
        if pointer in body and not body.startswith(("//", "/*")):
            return True
    return False


def derived(lines, sources, assigns):
    """Fold of assignments: {(line, variable, root line, root)}."""
    known = set()
    for line, var, side in assigns:
        new = {(line, var, sl, s) for s, sl in sources if sl < line and s in side}
        parents = sorted(p for p in known if p[0] < line and p[1] in side)
        if parents:
            new.add((line, var, parents[0][2], parents[0][3]))
        known |= new
    return known
