"""Times in texts, found among tokens: a small reader that runs in Arrow batches, since SQL has no offsets of matches.

From each token that can begin a time, what follows is read as a date, a clock, a zone or numbers
of weeks.  Only what is written is reported; what it means is left to ``times``.
"""

from __future__ import annotations

import re
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Names of months; one counts whole or by its first three letters.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
#: Zones by name, in minutes east of UTC; what joins two clocks to a range, and numbers of weeks to a list.
ZONES = {"utc": 0, "z": 0, "sgt": 480}
RANGE_WORDS = {"to", "until", "-", "–", "—"}
LIST_WORDS = {",", "and", "&"}

_MONTH = {name.lower()[:n]: i + 1 for i, name in enumerate(MONTHS) for n in (3, len(name))}
_PIECE = re.compile(r"[^\W\d_]+|\d+|\s+|\S")

#: ``parts`` are year, month, day; ``numbers`` those of a date that only has numbers, or of weeks; ``last_minutes`` the end of a range.
FOUND = T.StructType(
    [
        T.StructField(name, kind)
        for names, kind in (("start end", T.IntegerType()), ("text kind", T.StringType()), ("parts numbers", T.ArrayType(T.IntegerType())), ("minutes last_minutes zone", T.IntegerType()))
        for name in names.split()
    ]
)


#: No time looks further ahead of a token that may be there than this, but for lists of weeks, which stop at the first that isn't.
AHEAD = 12
#: What follows the first number of a date or clock; else it can't be one.
_FOLLOWS = {"-", "/", ":", ".", "st", "nd", "rd", "th", *_MONTH}


class Reader:
    """``t`` are the tokens in lower case, ``d`` how many digits each has, ``g`` whether it follows the one before without a blank."""

    def __init__(self, text: str):
        self.text = text
        self.t, self.d, self.g, self.starts, self.ends, at, glued = [], [], [], [], [], 0, False
        for piece in _PIECE.findall(text):
            end = at + len(piece)
            blank = piece.isspace()
            if not blank:
                self.t.append(piece.lower())
                self.d.append(end - at if piece.isdecimal() else 0)
                self.g.append(glued)
                self.starts.append(at)
                self.ends.append(end)
            glued, at = not blank, end
        self.n = len(self.t)
        # So that what is before the first and after the last is like nothing.
        self.t += [""] * AHEAD
        self.d += [0] * AHEAD
        self.g += [False] * AHEAD

    def joined(self, j: int, mark: str, *digits: range) -> bool:
        """Numbers of so many digits from j on, with nothing but the mark between them."""
        last = j + 2 * (len(digits) - 1)
        if self.t[j + 1] != mark:  # most often
            return False
        numbers = all(self.d[j + 2 * k] in n for k, n in enumerate(digits))
        return numbers and all(self.t[k] == mark for k in range(j + 1, last, 2)) and all(self.g[k] for k in range(j + 1, last + 1))

    def date(self, j: int) -> tuple[int, dict] | None:
        """Where a date that begins at j ends, and its parts: by month name, year-month-day, or numbers between slashes."""
        value = lambda k: int(self.t[k])
        if self.joined(j, "-", range(4, 5), range(2, 3), range(2, 3)):
            return j + 5, {"parts": [value(j), value(j + 2), value(j + 4)]}
        if self.joined(j, "/", range(1, 3), range(1, 3), range(2, 5)):
            return j + 5, {"numbers": [value(j), value(j + 2), value(j + 4)]}
        day, month = (j, None) if self.d[j] in (1, 2) else (j + 1, j)
        after = day + 1 + (self.g[day + 1] and self.t[day + 1] in ("st", "nd", "rd", "th"))
        month, after = (after, after + 1) if month is None else (month, after)
        year = after + (self.t[after] == ",")
        if self.d[day] in (1, 2) and self.t[month] in _MONTH and self.d[year] == 4:
            return year + 1, {"parts": [value(year), _MONTH[self.t[month]], value(day)]}
        return None

    def half(self, j: int) -> tuple[int, str]:
        """Where am or pm ends, if it stands at j, and which it is."""
        if self.t[j] in ("am", "pm"):
            return j + 1, self.t[j][0]
        if self.t[j] in ("a", "p") and self.t[j + 1] == "." and self.t[j + 2] == "m":
            return j + 3 + (self.t[j + 3] == "." and self.g[j + 3]), self.t[j]
        return j, ""

    def clock(self, j: int, other_half: str = "") -> tuple[int, int | None, str] | None:
        """Where a clock that begins at j ends, its minutes after midnight (None if it could be anything) and its half of the day.

        A dot clock up to 12 needs am or pm, maybe that of the other end of its range.
        """
        mark = self.t[j + 1]
        if mark not in (":", ".") or not self.joined(j, mark, range(1, 3), range(2, 3)):
            return None
        end = j + (5 if mark == ":" and self.joined(j, ":", range(1, 3), range(2, 3), range(2, 3)) else 3)
        end, own = self.half(end)
        half, hour, minute = own or other_half, int(self.t[j]), int(self.t[j + 2])
        sure = minute < 60 and (1 <= hour <= 12 if half else hour < 24 and not (mark == "." and hour <= 12))
        return end, (hour % 12 + 12 * (half == "p") if half else hour) * 60 + minute if sure else None, own

    def zone(self, j: int) -> tuple[int, int] | None:
        """Where a zone that begins at j ends, brackets included, and its minutes east of UTC."""
        k = j + (self.t[j] == "(")
        minutes, sign = ZONES.get(self.t[k]), {"+": 1, "-": -1}
        if self.t[k] == "utc" and self.t[k + 1] in sign and self.g[k + 1] and self.d[k + 2] in (1, 2) and self.g[k + 2]:
            minutes, k = sign[self.t[k + 1]] * int(self.t[k + 2]) * 60, k + 3
        elif minutes is not None:
            k += 1
        elif self.t[k] in sign and self.joined(k + 1, ":", range(2, 3), range(2, 3)) and self.g[k + 1]:
            minutes, k = sign[self.t[k]] * (int(self.t[k + 1]) * 60 + int(self.t[k + 3])), k + 4
        else:
            return None
        return k + (self.t[k] == ")"), minutes

    def weeks(self, j: int) -> tuple[int, dict] | None:
        if self.d[j + 1] not in (1, 2):
            return None
        end = j + 2
        while self.t[j] == "weeks" and self.t[end] in LIST_WORDS and self.d[end + 1] in (1, 2):
            end += 2
        numbers = [int(self.t[k]) for k in range(j + 1, end, 2)]
        many = self.t[j] == "weeks"
        return (end, {"kind": "weeks" if many else "week", "numbers": numbers}) if len(numbers) > many else None

    def moment(self, j: int) -> tuple[int, dict] | None:
        """A date, with the clock after it if that has a zone."""
        found = self.date(j)
        if found is None:
            return None
        end, said = found
        k = end + (self.t[end] == ",")
        k += self.t[k] == "t"
        k += self.t[k] == "at"
        clock = self.clock(k)
        zone = self.zone(clock[0]) if clock else None
        if zone:
            return zone[0], said | {"kind": "moment", "minutes": clock[1], "zone": zone[1]}
        return end, said | {"kind": "date"}

    def hours(self, j: int) -> tuple[int, dict] | None:
        """A clock, or two with a word of ranges between them; a half of the day that only the end names holds for both."""
        first = self.clock(j)
        if first is None:
            return None
        second = self.clock(first[0] + 1) if self.t[first[0]] in RANGE_WORDS else None
        end, said = first[0], {"kind": "clock", "minutes": first[1]}
        if second:
            shared = self.clock(j, second[2])[1]
            if shared is not None and second[1] is not None and shared < second[1]:
                end, said = second[0], {"kind": "range", "minutes": shared, "last_minutes": second[1]}
        zone = self.zone(end)
        return (zone[0], said | {"zone": zone[1]}) if zone else (end, said)

    def bounded(self, j: int, end: int) -> bool:
        """No letter, digit or underscore touches the tokens from j to end."""
        touches = lambda k: self.t[k].isalnum() or self.t[k] == "_"
        return not (self.g[j] and touches(j - 1)) and not (self.g[end] and touches(end))

    def one(self, j: int) -> tuple[int, dict] | None:
        """Where a time that begins at j ends, and what it says."""
        word = self.t[j]
        if word in ("week", "weeks"):
            return self.weeks(j)
        if word in _MONTH:
            return self.moment(j)
        return (self.moment(j) or self.hours(j)) if self.d[j] and self.t[j + 1] in _FOLLOWS else None

    def times(self) -> list[dict]:
        found, j = [], 0
        while j < self.n:
            got = self.one(j)
            if got and self.bounded(j, got[0]):
                start, stop = self.starts[j], self.ends[got[0] - 1]
                found.append({"start": start, "end": stop, "text": self.text[start:stop]} | got[1])
                j = got[0]
            else:
                j += 1
        return found


def read(text: str | None) -> list[dict]:
    """All times in a text, in order; none in a null or empty one."""
    if not text or not any(c.isdecimal() for c in text):
        return []
    return Reader(text).times()


def _read_all(texts: pa.Array) -> pa.Array:
    return pa.array([read(text) for text in texts.to_pylist()], to_arrow_type(T.ArrayType(FOUND)))


def found_times(c: Column) -> Column:
    """An array of all times in a text (see ``FOUND``), with their places in characters."""
    return F.arrow_udf(_read_all, T.ArrayType(FOUND))(c)


def _read_lists(lists: pa.Array) -> pa.Array:
    return pa.array([[read(text) for text in texts or []] for texts in lists.to_pylist()], to_arrow_type(T.ArrayType(T.ArrayType(FOUND))))


def found_in_each(c: Column) -> Column:
    """For an array of texts the times in each."""
    return F.arrow_udf(_read_lists, T.ArrayType(T.ArrayType(FOUND)))(c)
