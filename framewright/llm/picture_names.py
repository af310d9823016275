"""What a picture's file name says: where and when it was recorded, or its caption."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_RECORDED = r"([a-z]+) ([a-z]+) c(?:am)? ?0*([0-9]+) r(?:ec)? ?0*([0-9]+) (?:f(?:rame)? ?)?0*([0-9]+)(?![a-z0-9])"
#: Marks of copying or exporting that may stand after a name (before it: "copy of").
_MARK = r"(?: (?:copy|orig|original|resized|export|exported|final|edited|edit|small|large|thumb|[0-9]{1,3}|[0-9]+x[0-9]+))*"
_CAPTIONED = r"^(?:copy of )*(?:copy )*((?:[a-z]+ )+)([a-z]+) ([a-z]+) ?0*([0-9]+)" + _MARK + r"(?: (?:jpe?g|png|webp|tiff?|gif|bmp))?$"
_BLANK = r"[^a-z0-9]+"
#: What nobody's name is written like.
NOBODY = ("", "unknown", "n/a", "na", "-", "--", "?", "anonymous", "anon", "none", "null", "nobody", "no name", "user", "n.a.")


def plain_name(name: Column) -> Column:
    """Lower-case words and numbers of a path, one blank between; folders kept, escapes undone, joined capitals parted."""
    text = F.regexp_replace(F.coalesce(name, F.lit("")), r"%20|\+", " ")
    text = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(text), _BLANK, " "))


def last_name(name: Column) -> Column:
    """The last step of a path, written plainly."""
    return plain_name(F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/\\]*)$", 1))


#: Stands before and between the parts of a name that was recognised; no plain name has it.
_PART = "\u0001"


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def _recorded(name: Column, parts: str) -> Column:
    """Parts of a recorded name, else null: the first match is cut out, and written anew, by one pattern each."""
    match = F.regexp_extract(plain_name(name), _RECORDED, 0)
    return _once(F.regexp_replace(match, _RECORDED, parts), lambda x: F.when(x != "", x))


def recording_key(name: Column) -> Column:
    """``site camera recording`` of a recorded name, else null."""
    return _recorded(name, "$1 $2 $3 $4")


def frame_key(name: Column) -> Column:
    """``site camera recording frame`` of a recorded name, else null."""
    return _recorded(name, "$1 $2 $3 $4 $5")


def caption_of(name: Column) -> Column:
    """struct(place: ``site serial``, caption: its letters) of a name written like a captioned one, else null; a recorded name may be too."""
    parts = F.split(F.regexp_replace(last_name(name), _CAPTIONED, f"{_PART}$2 $3 $4{_PART}$1"), _PART)
    return _once(parts, lambda x: F.when(F.size(x) == 3, F.struct(x[1].alias("place"), F.replace(x[2], F.lit(" "), F.lit("")).alias("caption"))))


def caption_parts(name: Column) -> Column:
    """``caption_of`` a captioned name, else null."""
    return F.when(frame_key(name).isNull(), caption_of(name))


def person_key(uploader: Column) -> Column:
    """An uploader in lower case, without outer blanks and leading @; null for nobody."""
    name = F.trim(F.regexp_replace(F.trim(F.lower(uploader)), r"^@+", ""))
    return F.when(~name.isin(*NOBODY), name)


def split_name(split: Column) -> Column:
    """train, valid, eval or null."""
    s = F.trim(F.lower(split))
    return F.when(s == "val", "valid").when(s == "test", "eval").when(s.isin("train", "valid", "eval"), s)
