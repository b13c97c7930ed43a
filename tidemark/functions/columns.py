"""Column functions over text, arrays and dates.  ASCII classes are spelled out so that engines agree on them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _literal(v: str | int) -> str:
    return str(v) if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def texts(values: Iterable[str]) -> Column:
    """An array literal of strings, as one expression: a call for each value would make long tables slow to plan."""
    values = list(values)
    return F.expr(f"array({', '.join(map(_literal, values))})") if values else F.array().cast("array<string>")


def mapping(pairs: dict[str, str | int]) -> Column:
    return F.expr(f"map({', '.join(_literal(x) for pair in pairs.items() for x in pair)})")


def collapse(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f]+", " "))


def plain_title(c: Column) -> Column:
    """Lower case; all but a-z, 0-9 and spaces deleted; collapsed."""
    return collapse(F.regexp_replace(F.lower(c), r"[^a-z0-9 \t\r\n\f]", ""))


def plain_text(c: Column) -> Column:
    """Lower case; all but a-z and 0-9 made spaces; collapsed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def title_fingerprint(c: Column, stopwords: list[str], most: int = 8) -> Column:
    return F.array_join(F.slice(F.filter(tokens(plain_title(c)), lambda t: ~t.isin(stopwords)), 1, most), " ")


def keyword_set(c: Column, stopwords: list[str]) -> Column:
    """Distinct words of 4 or more characters that are no stopwords."""
    return F.array_distinct(F.filter(tokens(plain_text(c)), lambda t: (F.length(t) >= 4) & ~t.isin(stopwords)))


def distinct_ignoring_case(c: Column) -> Column:
    """First of each value that agrees but for case, in order; the list and its lower-cased values are made once, not for each value."""

    def firsts(own: Column) -> Column:
        return bind(F.transform(own, lambda x: F.lower(x)), lambda low: F.filter(own, lambda x, i: F.array_position(low, F.get(low, i)) == i + 1))

    return bind(c, firsts)


def clean_list(c: Column) -> Column:
    """Trimmed, without blanks."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def renamed(c: Column, names: dict[str, str]) -> Column:
    """Each element's canonical name, or the element itself; in order, without repeats."""
    return F.array_distinct(F.transform(c, lambda x: F.coalesce(F.try_element_at(mapping(names), F.lower(x)), x)))


def word(pattern: str) -> str:
    """The pattern between characters other than ASCII letters, digits and the underscore."""
    return rf"(?i)(^|[^A-Za-z0-9_]){pattern}($|[^A-Za-z0-9_])"


def bounded(pattern: str) -> str:
    """A pattern of the vocabularies with \\b spelled out where it stands at the ends (one engine has no \\b for accents)."""
    head, tail = ("(^|[^A-Za-z0-9_])", pattern[2:]) if pattern.startswith(r"\b") else ("", pattern)
    return "(?i)" + head + (tail[:-2] + "($|[^A-Za-z0-9_])" if tail.endswith(r"\b") else tail)


def any_like(c: Column, patterns: Iterable[str]) -> Column:
    """One pattern with all of them as alternatives."""
    return c.rlike("(?i)" + "|".join(f"(?:{bounded(p)[4:]})" for p in patterns))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tells_any(c: Column, patterns: Iterable[str]) -> Column:
    """any_like() for a lower-cased text and patterns in lower case: literal ones are looked up as such, and of others their literal head first."""
    out = F.lit(False)
    for p in patterns:
        head = re.match(r"(?:\\b)?([a-z0-9 -]*)", p).group(1)
        if head == p:
            out = out | c.contains(p)
            continue
        if p.removeprefix(r"\b")[len(head) : len(head) + 1] in ("?", "*", "{"):
            head = head[:-1]
        like = c.rlike(bounded(p)[4:])
        out = out | (c.contains(head) & like if head and "|" not in p else like)
    return out


def contains_any(c: Column, parts: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def company_name(c: Column, names: dict[str, str], suffixes: list[str]) -> Column:
    """Canonical company: by table, else without legal suffixes and by table again, else without them."""
    trimmed = collapse(c)
    endings = "|".join(s.replace(".", r"\.") for s in sorted(suffixes, key=lambda s: (-len(s), s)))
    bare = F.regexp_replace(trimmed, rf"(?i)( ({endings}))+$", "")
    table = mapping(names)
    return F.coalesce(F.try_element_at(table, F.lower(trimmed)), F.try_element_at(table, F.lower(bare)), bare)


def made_date(year: Column, month: Column, day: Column) -> Column:
    """A date of texts; null where one is empty, the month is no name of one, or there is no such day."""
    number = F.try_element_at(mapping(MONTHS), F.lower(month))
    return F.try_to_date(F.concat_ws("-", F.nullif(year, F.lit("")), F.lpad(number.cast("string"), 2, "0"), F.lpad(F.nullif(day, F.lit("")), 2, "0")), "yyyy-MM-dd")


#: Months by their English names, whole, by three letters, and "sept".
MONTHS = {**{name: k for k, m in enumerate("january february march april may june july august september october november december".split(), 1) for name in (m[:3], m)}, "sept": 9}
ISO_DATE = r"(^|[^0-9A-Za-z_])([0-9]{4}-[0-9]{2}-[0-9]{2})($|[^0-9A-Za-z_])"
DAY_MONTH_YEAR = r"(^|[^0-9A-Za-z_])([0-9]{1,2})[ \t\r\n\f]+([A-Za-z]{3,9})[ \t\r\n\f]+([0-9]{4})($|[^0-9A-Za-z_])"
#: DAY_MONTH_YEAR with its first digit before the look at what stands there: found at the same place, and letters are passed over at once.
DAY_FIRST = r"([0-9](?<![0-9A-Za-z_][0-9])[0-9]?)[ \t\r\n\f]+([A-Za-z]{3,9})[ \t\r\n\f]+([0-9]{4})($|[^0-9A-Za-z_])"
MONTH_DAY_YEAR = r"(^|[^0-9A-Za-z_])([A-Za-z]{3,9})\.?[ \t\r\n\f]+([0-9]{1,2}),[ \t\r\n\f]*([0-9]{4})($|[^0-9A-Za-z_])"


def is_iso(c: Column) -> Column:
    return c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull()


def first_date(c: Column) -> Column:
    """The first ISO, else day-month-year, else month-day-year date of a text; only the first place of each form is tried.

    A text is looked through once for each form, and only if it has what every date of that form has (four digits beside a
    hyphen, a month's letters or a day's comma); the parts come from what is found.
    """
    part = lambda m, p, k: F.regexp_extract(m, p, k)

    def whole(text: Column, needs: str, pattern: str, year: int, month: int, day: int) -> Column:
        made = bind(part(text, pattern, 0), lambda m: F.when(m != "", made_date(*(part(m, pattern, k) for k in (year, month, day)))))
        return F.when(text.rlike(needs), made)

    def found(text: Column) -> Column:
        iso = F.when(text.rlike("[0-9]{4}-[0-9]{2}-"), F.try_to_date(F.nullif(part(text, ISO_DATE, 2), F.lit("")), "yyyy-MM-dd"))
        return F.coalesce(iso, whole(text, r"[0-9][ \t\r\n\f]+[A-Za-z]{3,9}[ \t\r\n\f]+[0-9]{4}", DAY_FIRST, 3, 2, 1), whole(text, r"[0-9],[ \t\r\n\f]*[0-9]{4}", MONTH_DAY_YEAR, 4, 2, 3))

    return bind(c, lambda text: F.when(text.rlike("[0-9]{4}"), found(text)))
