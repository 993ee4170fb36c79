"""Sections and notes by plain loops over lines: what the engine's expressions must give."""

from __future__ import annotations

from ledgermark.functions.text import BETWEEN, BETWEEN_LENGTH, FOLLOWS, ITEMS, LONGEST_TITLE, NOTE_HEADING, NOTES_TITLES, PLAUSIBLE, PLAUSIBLE_OTHER, POINTER, PROXY, PROXY_OTHER, filing_text

SEPARATORS = "-–—:."


def _numbered(words: str, letter: bool = False) -> tuple[str, str]:
    """The number (one or two digits, and a letter if that is allowed) that a text begins with, and the rest; or two empty texts."""
    n = next((i for i, c in enumerate(words) if not ("0" <= c <= "9")), len(words))
    if not 0 < n <= 2:
        return "", ""
    if letter and words[n : n + 1].isascii() and words[n : n + 1].isalpha() and not words[n + 1 : n + 2].isalnum():
        n += 1
    return words[:n].upper(), words[n:]


def _item_of(line: str) -> str:
    """The item that a line is the heading of ("Item 7A. ..."), or an empty text."""
    first, _, rest = line.strip().partition(" ")
    return _numbered(rest.lstrip(), letter=True)[0] if first.casefold() == "item" else ""


def _title(line: str) -> str:
    """A heading in capitals, with single blanks, its abbreviations written out, without a colon at its end."""
    words = line.strip().removesuffix(":").upper().replace("&", " AND ").split()
    return " ".join("VERSUS" if w in ("VS", "VS.") else w for w in words)


def _proxy_of(line: str) -> str | None:
    """The section that a line is the title of; OTHER for a title that only ends one; None for no title."""
    if len(line) > 2 * LONGEST_TITLE:
        return None
    title = _title(line)
    if title in PROXY:
        return PROXY[title]
    return "OTHER" if any(title.startswith(x) and len(title) <= len(x) + LONGEST_TITLE for x in PROXY_OTHER) else None


def _notes_at(lines: list[str]) -> int | None:
    """The line with the title of the notes: the first such line soon followed by a first note."""
    for i, line in enumerate(lines):
        if _title(line) in NOTES_TITLES:
            for x in lines[i + 1 : i + 2 + BETWEEN]:
                number, rest = _numbered(x.strip().upper().removeprefix("NOTE").lstrip())
                if number == "1" and rest.lstrip()[:1] in SEPARATORS and rest.strip():
                    return i
                if len(x) > BETWEEN_LENGTH:
                    break
    return None


def confidence(item: str, length: int, ended_at: str | None) -> float:
    """Trust in a section: lower if it is short for its item, ends unexpectedly, or never ends."""
    plausible = PLAUSIBLE.get(item, PLAUSIBLE_OTHER)
    x = max(0.15, length / plausible) if length < plausible else 1.0
    if ended_at is None:
        x *= 0.6
    elif ended_at not in FOLLOWS.get(item, ()):
        x *= 0.8
    return round(min(1.0, x), 3)


def _longest(spans: list[dict]) -> list[dict]:
    best: dict[str, dict] = {}
    for s in spans:
        if s["item"] not in best or len(s["text"]) > len(best[s["item"]]["text"]):
            best[s["item"]] = s
    return [s for s in best.values() if s["text"]]


def _between(lines: list[str], heads: list[tuple[int, str]]) -> list[tuple[str, str, str | None, str]]:
    """Of each heading (line, name): its name, the text up to the next heading of another name, that name, and its own line."""
    out, following = [], (len(lines), None)
    for k in range(len(heads) - 1, -1, -1):
        at, name = heads[k]
        if k + 1 < len(heads) and heads[k + 1][1] != name:
            following = heads[k + 1]
        out.append((name, "\n".join(lines[at + 1 : following[0]]).strip(), following[1], lines[at].strip()))
    return out[::-1]


def item_sections(page: str | None, items: tuple[str, ...] = ITEMS) -> list[dict]:
    """Sections of an annual report: each from its heading to the next heading of another item, the longest for each
    item. An item 8 that is absent or only points elsewhere is replaced by the notes filed at the end."""
    lines = filing_text(page).split("\n")
    heads = [(i, item) for i, line in enumerate(lines) if (item := _item_of(line))]
    wanted = {i.upper() for i in items}
    found = _longest([{"item": n, "text": t, "confidence": confidence(n, len(t), end), "ended_at": end, "heading": h} for n, t, end, h in _between(lines, heads) if n in wanted])
    if "8" in wanted and all(len(s["text"]) < POINTER for s in found if s["item"] == "8"):
        at = _notes_at(lines)
        if at is not None:
            notes = {"item": "8", "text": "\n".join(lines[at:]).strip(), "confidence": 0.8, "ended_at": None, "heading": " ".join(lines[at].split())}
            found = [s for s in found if s["item"] != "8"] + [notes]
    return found


def proxy_sections(page: str | None) -> list[dict]:
    """Named sections of a proxy statement, each to the next known title, the longest for each name."""
    lines = filing_text(page).split("\n")
    heads = [(i, name) for i, line in enumerate(lines) if (name := _proxy_of(line))]
    spans = []
    for (at, name), (stop, ended_at) in zip(heads, [*heads[1:], (len(lines), None)], strict=False):
        if name != "OTHER":
            spans.append({"item": name, "text": "\n".join(lines[at + 1 : stop]).strip(), "confidence": 0.9 if ended_at else 0.6, "ended_at": ended_at, "heading": " ".join(lines[at].split())})
    return _longest(spans)


def _kind_of_line(line: str) -> tuple[str, int]:
    """What a line of the notes may be: ("note", n) for "Note n ...", ("bare", n) for "n. Capital ...", else ("", 0)."""
    line = line.strip()
    if line[:4].upper() == "NOTE" and line[4:5] in (" ", "\t"):
        number, rest = _numbered(line[4:].lstrip())
        if number and not rest.lstrip().startswith(",") and len(rest) <= NOTE_HEADING + 4:
            return "note", int(number)
    number, rest = _numbered(line)
    if number and rest[:1] == "." and rest[1:2] in (" ", "\t") and "A" <= rest[1:].lstrip()[:1] <= "Z" and len(rest) <= NOTE_HEADING + 4:
        return "bare", int(number)
    return "", 0


def split_notes(text: str | None) -> list[dict]:
    """Numbered notes of financial statements; a text without numbered headings is one note without a number.

    "Note n" opens a note if n is larger than all before. Without such headings the numbers 1, 2, 3 at the begin of lines do,
    each as soon as it comes; but another 1 opens a list, and numbers that go on with the list are its own."""
    lines = (text or "").split("\n")
    kinds = [(i, *kind) for i, line in enumerate(lines) if (kind := _kind_of_line(line))[0]]
    opened: list[tuple[int, int]] = []
    if any(kind == "note" for _, kind, _ in kinds):
        for i, kind, n in kinds:
            if kind == "note" and n > (opened[-1][1] if opened else 0):
                opened.append((i, n))
    else:
        of_list = 0  # the number with which an open list would go on; 0 without one
        for i, _, n in kinds:
            if of_list and n == of_list:
                of_list += 1
            elif n == 1 and opened:
                of_list = 2
            elif n == len(opened) + 1:
                opened.append((i, n))
                of_list = 0
    if not opened:
        whole = "\n".join(lines).strip()
        return [{"number": None, "heading": None, "text": whole, "char_count": len(whole)}]
    ends = [i for i, _ in opened[1:]] + [len(lines)]
    bodies = ["\n".join(lines[i:end]).strip() for (i, _), end in zip(opened, ends, strict=True)]
    return [{"number": str(n), "heading": " ".join(lines[i].split()), "text": body, "char_count": len(body)} for (i, n), body in zip(opened, bodies, strict=True)]
