"""Sections and notes of a filing's text, as expressions on the array of its lines.

Headings are the lines that match; neighbouring headings of one name are an island, of which the first line begins a section
and the next island ends it. Notes are opened by a fold over the numbered lines, whose state is what is open so far. All of
it stays within a filing's row and the JVM: no shuffle, no Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermark.functions import text as tx

#: White space at the ends of texts.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"
_ITEM = r"(?U)^\s*(?i:item) \s*([0-9]{1,2}(?![0-9])(?:[A-Za-z](?![\p{L}\p{N}]))?)"
_FIRST_NOTE = r"(?U)^\s*(?i:note)?\s*1(?![0-9])\s*[-–—:.]\s*\S|(?U)^\s*(?i:note)?\s*1(?![0-9])\s*[-–—:.]$"
_NOTE = rf"(?Us)^\s*(?i:note)[ \t]\s*([0-9]{{1,2}})(?![0-9])(?!\s*,).{{0,{tx.NOTE_HEADING + 4}}}$"
_BARE = rf"(?Us)^\s*([0-9]{{1,2}})(?=\.[ \t]\s*[A-Z]).{{0,{tx.NOTE_HEADING + 4}}}$"


def given(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is named: a lambda over an array of one."""
    return F.element_at(F.transform(F.array(value), then), 1)


def lines(text: str | Column) -> Column:
    """Lines of a text (null: one empty line)."""
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n")


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def single(c: Column) -> Column:
    """One blank for each run of white space, none at the ends."""
    return stripped(F.regexp_replace(c, r"(?U)\s+", " "))


def body(all_lines: Column, begin: Column, end: Column) -> Column:
    """Text of the lines from number ``begin`` up to ``end``, without white space at its ends."""
    return stripped(F.array_join(F.slice(all_lines, begin + 1, F.greatest(end - begin, F.lit(0))), "\n"))


def item_of(line: Column) -> Column:
    """The item that a line is the heading of ("Item 7A. ..."), or an empty text."""
    return F.upper(F.regexp_extract(line, _ITEM, 1))


def title(line: Column) -> Column:
    """A heading in capitals, with single blanks, its abbreviations written out, without a colon at its end."""
    said = F.regexp_replace(F.upper(F.regexp_replace(stripped(line), ":$", "")), "&", " AND ")
    return single(F.regexp_replace(F.concat(F.lit(" "), F.regexp_replace(said, r"(?U)\s+", "  "), F.lit(" ")), r" VS\.? ", " VERSUS "))


def proxy_of(line: Column) -> Column:
    """The section that a line is the title of; OTHER for a title that only ends one; an empty text for no title."""
    named = F.create_map(*[F.lit(x) for pair in tx.PROXY.items() for x in pair])

    def judged(t: Column) -> Column:
        other = [t.startswith(x) & (F.length(t) <= len(x) + tx.LONGEST_TITLE) for x in tx.PROXY_OTHER]
        said = other[0]
        for o in other[1:]:
            said = said | o
        return F.coalesce(named[t], F.when(said, "OTHER"), F.lit(""))

    return F.when(F.length(line) > 2 * tx.LONGEST_TITLE, "").otherwise(given(title(line), judged))


def heads(all_lines: Column, name: Callable[[Column], Column]) -> Column:
    """Number and name of each line that has one."""
    every = F.transform(all_lines, lambda x, i: F.struct(i.alias("at"), name(x).alias("name")))
    return F.filter(every, lambda h: h["name"] != "")


def islands(found: Column) -> Column:
    """Of each run of headings of one name the first."""
    return given(found, lambda f: F.filter(f, lambda h, i: (i == 0) | (h["name"] != F.get(f, i - 1)["name"])))


def spans(all_lines: Column, found: Column, heading: Callable[[Column], Column]) -> Column:
    """Of each heading its name, the text up to the next one, the next one's name (null at the end), and its own line."""

    def one(f: Column, h: Column, i: Column) -> Column:
        text = body(all_lines, h["at"] + 1, F.coalesce(F.get(f, i + 1)["at"], F.size(all_lines)))
        return F.struct(h["name"].alias("item"), text.alias("text"), F.get(f, i + 1)["name"].alias("ended_at"), heading(F.get(all_lines, h["at"])).alias("heading"))

    return given(found, lambda f: F.transform(f, lambda h, i: one(f, h, i)))


def longest(some: Column, names: tuple[str, ...]) -> Column:
    """Of each name the longest text, the first of those as long; none that is empty."""

    def best(own: Column) -> Column:
        most = F.array_max(F.transform(own, lambda s, i: F.struct(F.length(s["text"]).alias("n"), (-i).alias("first"))))
        return F.get(own, -most["first"])

    every = given(some, lambda f: F.transform(F.array(*map(F.lit, names)), lambda name: given(F.filter(f, lambda s: s["item"] == name), best)))
    return F.filter(every, lambda s: s.isNotNull() & (s["text"] != ""))


def confidence(item: Column, length: Column, ended_at: Column) -> Column:
    """Trust in a section: lower if it is short for its item, ends unexpectedly, or never ends."""
    least, follows = F.lit(tx.PLAUSIBLE_OTHER), F.lit(False)
    for name, n in tx.PLAUSIBLE.items():
        least = F.when(item == name, n).otherwise(least)
    for name, after in tx.FOLLOWS.items():
        follows = follows | ((item == name) & ended_at.isin(*after))
    x = F.when(length < least, F.greatest(F.lit(0.15), length / least)).otherwise(1.0)
    x = x * F.when(ended_at.isNull(), 0.6).when(~follows, 0.8).otherwise(1.0)
    return F.least(F.lit(1.0), x)


def notes_at(all_lines: Column) -> Column:
    """Number of the line with the title of the notes: the first such line soon followed by a first note (null: none)."""
    titles = F.filter(F.transform(all_lines, lambda x, i: F.when(F.upper(x).contains("NOTES") & title(x).isin(*tx.NOTES_TITLES), i)), lambda i: i.isNotNull())

    def near(i: Column) -> Column:
        after = F.slice(all_lines, i + 2, F.lit(1 + tx.BETWEEN))
        step = lambda a, x: F.when(a != 0, a).when(x.rlike(_FIRST_NOTE), 1).when(F.length(x) > tx.BETWEEN_LENGTH, 2).otherwise(0)
        return F.aggregate(after, F.lit(0), step) == 1

    return F.get(F.filter(titles, near), F.lit(0))


def item_sections(all_lines: Column, items: tuple[str, ...] = tx.ITEMS) -> Column:
    """Sections of an annual report: each from its heading to the next heading of another item, the longest for each
    item. An item 8 that is absent or only points elsewhere is replaced by the notes filed at the end."""
    wanted = tuple(dict.fromkeys(i.upper() for i in items))
    found = longest(spans(all_lines, islands(heads(all_lines, item_of)), stripped), wanted)
    sure = lambda s: F.struct(s["item"].alias("item"), s["text"].alias("text"), confidence(s["item"], F.length(s["text"]), s["ended_at"]).alias("confidence"), s["ended_at"].alias("ended_at"), s["heading"].alias("heading"))
    found = F.transform(found, sure)
    if "8" not in wanted:
        return found

    def with_notes(f: Column, at: Column) -> Column:
        notes = F.struct(F.lit("8").alias("item"), body(all_lines, at, F.size(all_lines)).alias("text"), F.lit(0.8).alias("confidence"), F.lit(None).cast("string").alias("ended_at"), single(F.get(all_lines, at)).alias("heading"))
        return F.when(at.isNull(), f).otherwise(F.concat(F.filter(f, lambda s: s["item"] != "8"), F.array(notes)))

    points = lambda f: F.forall(f, lambda s: (s["item"] != "8") | (F.length(s["text"]) < tx.POINTER))
    return given(found, lambda f: F.when(~points(f), f).otherwise(given(notes_at(all_lines), lambda at: with_notes(f, at))))


def proxy_sections(all_lines: Column) -> Column:
    """Named sections of a proxy statement, each to the next known title, the longest for each name."""
    every = F.filter(spans(all_lines, heads(all_lines, proxy_of), single), lambda s: s["item"] != "OTHER")
    sure = lambda s: F.struct(s["item"].alias("item"), s["text"].alias("text"), F.when(s["ended_at"].isNotNull(), 0.9).otherwise(0.6).alias("confidence"), s["ended_at"].alias("ended_at"), s["heading"].alias("heading"))
    return F.transform(longest(every, tuple(dict.fromkeys(tx.PROXY.values()))), sure)


def split_notes(all_lines: Column) -> Column:
    """Numbered notes of financial statements; a text without numbered headings is one note without a number.

    "Note n" opens a note if n is larger than all before. Without such headings the numbers 1, 2, 3 at the begin of lines do,
    each as soon as it comes; but another 1 opens a list, and numbers that go on with the list are its own."""

    def numbered(pattern: str) -> Column:
        every = F.transform(all_lines, lambda x, i: F.struct(i.cast("int").alias("at"), F.regexp_extract(x, pattern, 1).try_cast("int").alias("n")))
        return F.filter(every, lambda k: k["n"].isNotNull())

    none = F.array().cast("array<struct<at:int,n:int>>")

    def rising(a: Column, k: Column) -> Column:
        last = F.coalesce(F.get(a, F.size(a) - 1)["n"], F.lit(0))
        return F.when(k["n"] > last, F.concat(a, F.array(k))).otherwise(a)

    def counted(a: Column, k: Column) -> Column:
        goes_on = (a["list"] > 0) & (k["n"] == a["list"])
        lists = (k["n"] == 1) & (F.size(a["open"]) > 0)
        opens = ~goes_on & ~lists & (k["n"] == F.size(a["open"]) + 1)
        rest = F.when(goes_on, a["list"] + 1).when(lists, F.lit(2)).when(opens, F.lit(0)).otherwise(a["list"])
        return F.struct(F.when(opens, F.concat(a["open"], F.array(k))).otherwise(a["open"]).alias("open"), rest.alias("list"))

    def opened() -> Column:
        plain = F.aggregate(numbered(_BARE), F.struct(none.alias("open"), F.lit(0).alias("list")), counted)["open"]
        return given(numbered(_NOTE), lambda named: F.when(F.size(named) > 0, F.aggregate(named, none, rising)).otherwise(plain))

    def note(text: Column, k: Column) -> Column:
        return F.struct(k["n"].cast("string").alias("number"), single(F.get(all_lines, k["at"])).alias("heading"), text.alias("text"), F.length(text).alias("char_count"))

    def notes(found: Column) -> Column:
        end = lambda i: F.coalesce(F.get(found, i + 1)["at"], F.size(all_lines))
        return F.transform(found, lambda k, i: given(body(all_lines, k["at"], end(i)), lambda text: note(text, k)))

    nothing = F.lit(None).cast("string")
    whole = given(body(all_lines, F.lit(0), F.size(all_lines)), lambda text: F.array(F.struct(nothing.alias("number"), nothing.alias("heading"), text.alias("text"), F.length(text).alias("char_count"))))
    return given(opened(), lambda found: F.when(F.size(found) > 0, notes(found)).otherwise(whole))
