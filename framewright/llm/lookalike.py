"""One form for texts that look the same, by Viterbi search over look-alike letters."""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.session import scratch_path

#: Letters of one shape, as drawn alike in common fonts. First the Latin letter, then those of other scripts (Cyrillic, Greek, Armenian, Lisu, Tifinagh, Canadian syllables, small capitals).
LOOK_ALIKE = {
    "A": "АΑꓮ", "B": "ВΒꓐ", "C": "СϹꓚ", "D": "ꓓᗞ", "E": "ЕΕꓰⴹ", "F": "Ϝꓝ", "G": "ꓖ", "H": "НΗꓧᕼ", "I": "ІӀΙꓲⵏ", "J": "ЈͿ", "K": "КΚꓗ", "L": "ꓡᒪ", "M": "МΜꓟ",
    "N": "Νꓠ", "O": "ОΟՕꓳ", "P": "РΡꓑ", "Q": "Ԛ", "R": "ꓣ", "S": "Ѕꓢ", "T": "ТΤꓔ", "U": "Սꓴᑌ", "V": "ꓦⴸᐯ", "W": "Ԝꓪ", "X": "ХΧꓫⵝ", "Y": "ҮΥꓬ", "Z": "Ζꓜ",
    "a": "а", "c": "сϲᴄ", "d": "ԁ", "e": "е", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօᴏ", "p": "р", "q": "ԛ", "s": "ѕꜱ", "u": "ս", "v": "ᴠ", "w": "ԝᴡ", "x": "х", "y": "у", "z": "ᴢ",
    "æ": "ӕ", "Æ": "Ӕ",
}
#: Marks of one shape.
SAME_MARK = {"‐": "-", "‑": "-", " ": "\n", " ": "\n", "\x85": "\n"}
#: Words kept per worker and their greatest length; both only save time.
CACHE_WORDS, CACHE_CHARS = 1 << 17, 40
#: Words counted before a partial result is passed on.
FLUSH_WORDS = 1 << 17
#: Cost, in nats, of changing the script inside a word, and of taking a letter for one that it was learned to look like.
SWITCH_COST, LEARNED_COST = 12.0, 1.0
#: A look-alike is learned from so many strays at least, if the best letter is so many nats likelier than the next, and not rarer in its places than LEARN_FIT nats a letter below the corpus' own.
LEARN_COUNT, LEARN_MARGIN, LEARN_FIT = 20, 10.0, 1.5

_LATIN, _CYRILLIC, _GREEK, _ARMENIAN, _LISU, _OTHER = range(6)
_SHAPE = {c: latin for latin, others in LOOK_ALIKE.items() for c in others}
_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
_KEEP_JOINER = re.compile("(?<=[☀-➿\U0001f000-\U0001faff️])‍(?=[☀-➿\U0001f000-\U0001faff])|(?<=[؀-෿])[‌‍]")
_HELD = {"‌": "", "‍": ""}
_BACK = {ord(v): k for k, v in _HELD.items()}


def script(c: str) -> int | None:
    """Latin, Cyrillic, Greek, Armenian, Lisu, one of the other alphabets with look-alikes, or None, by code block."""
    o = ord(c)
    if o < 0x250 or 0x1D00 <= o < 0x1F00 or 0xA720 <= o < 0xA800:
        return _LATIN
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return _GREEK
    if 0x400 <= o < 0x530:
        return _CYRILLIC
    if 0x530 <= o < 0x590:
        return _ARMENIAN
    if 0xA4D0 <= o < 0xA500:
        return _LISU
    return _OTHER if 0x1400 <= o < 0x1680 or 0x2D30 <= o < 0x2D80 else None


@lru_cache(maxsize=1)
def _plain() -> dict[int, str]:
    """Translation by rule: width forms, ligatures, blanks and unseen characters.

    A compatibility form is replaced where it is the same to a reader: wide, narrow and
    non-breaking forms, ligatures of letters, and the blanks of one space. Superscripts,
    fractions, circled or styled letters look different and stay.
    """
    table: dict[int, str] = {}
    for o in range(0x110000):
        c = chr(o)
        kind = unicodedata.category(c)
        if kind == "Cf" or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0) or 0x180B <= o <= 0x180D:
            table[o] = ""
            continue
        if o < 0x80:
            continue
        if kind == "Zs":
            table[o] = " "
            continue
        tag, _, rest = unicodedata.decomposition(c).partition(" ")
        if tag in ("<wide>", "<narrow>", "<noBreak>") or (tag == "<compat>" and " LIGATURE " in f" {unicodedata.name(c, '')} " and kind == "Ll"):
            table[o] = "".join(chr(int(x, 16)) for x in rest.split())
    table |= {ord(a): b for a, b in SAME_MARK.items()}
    return table


def clean(text: str) -> str:
    """Compatibility normalisation and deletion of ignorable characters, fully decomposed; line ends become one."""
    if text.isascii():
        return text.replace("\r\n", "\n").replace("\r", "\n")
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "‍" in text or "‌" in text:
        text = _KEEP_JOINER.sub(lambda m: _HELD[m[0]], text)
    if _special().search(text):
        text = text.translate(_plain())
    return unicodedata.normalize("NFD", text)


@lru_cache(maxsize=1)
def _special() -> re.Pattern[str]:
    """The characters that ``_plain`` changes; most texts have none, and looking is faster than translating."""
    runs: list[list[int]] = []
    for o in sorted(_plain()):
        if runs and runs[-1][1] == o - 1:
            runs[-1][1] = o
        else:
            runs.append([o, o])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")


_TO_SHAPE = {ord(c): latin for c, latin in _SHAPE.items()}


def word_pairs(word: str) -> Iterator[tuple[str, str]]:
    letters = [c for c in word if not unicodedata.combining(c)]
    yield from zip(["^", *letters], [*letters, "$"], strict=True)


def own_scripts(shape: str) -> set[int | None]:
    """Scripts of the letters of a word of shapes that have no Latin letter of their shape."""
    return {script(c) for c in shape if not c.isascii() and not unicodedata.combining(c)} - {_LATIN}


def writable(c: str, kind: int | None) -> str | None:
    """The letter of a script that has the shape ``c``, if there is one."""
    if script(c) == kind:
        return c
    return next((o for o in LOOK_ALIKE.get(c, "") if script(o) == kind), None)


def is_mixed(shape: str) -> bool:
    """Whether a word of shapes has letters of its own in another script than Latin and can't be wholly written in that script."""
    own = own_scripts(shape)
    if not own or None in own:
        return False
    return len(own) > 1 or any(not unicodedata.combining(c) and writable(c, next(iter(own))) is None for c in shape)


def letter_pairs(df: DataFrame, text: str = "text") -> DataFrame:
    """``(a, b, n, stray)``: how often letter b follows letter a in the words of all texts; ^ and $ are a word's ends.

    Words of one script, as written, are counted as they are. Words of shapes that no single script
    can write are counted apart (``stray``): they tell what a letter is taken for. Other disguised
    words teach nothing. Words are counted per task first; the result is bounded by twice the square
    of the alphabets. Null and empty texts add nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    words.update(_WORD.findall(clean(t)))
            if len(words) > FLUSH_WORDS:
                yield _counted(words)
                words.clear()
        yield _counted(words)

    pairs = df.select(F.col(f"`{text}`")).filter(F.col(text).isNotNull()).mapInArrow(run, "a string, b string, n bigint, stray boolean")
    return pairs.groupBy("a", "b", "stray").agg(F.sum("n").alias("n")).select("a", "b", "n", "stray")


def _counted(words: Counter[str]) -> pa.RecordBatch:
    pairs: Counter[tuple[str, str, bool]] = Counter()
    for word, n in words.items():
        scripts = {_LATIN} if word.isascii() else {script(c) for c in word if not unicodedata.combining(c)}
        if None in scripts:
            continue
        if len(scripts) == 1:
            for a, b in word_pairs(word):
                pairs[a, b, False] += n
        elif is_mixed(shape := word.translate(_TO_SHAPE)):
            for a, b in word_pairs(shape):
                pairs[a, b, True] += n
    cols = list(zip(*pairs, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(list(pairs.values()), pa.int64()), pa.array(cols[2], pa.bool_())], names=["a", "b", "n", "stray"])


class Forms:
    """The form of a text under letter-pair counts ``(a, b, n[, stray])``."""

    def __init__(self, pairs: list[tuple]) -> None:
        self.first: Counter[str] = Counter()
        self.n: dict[tuple[str, str], int] = {}
        strays: list[tuple[str, str, int]] = []
        for a, b, n, *stray in pairs:
            if stray and stray[0]:
                strays.append((a, b, n))
            else:
                self.first[a] += n
                self.n[a, b] = n
        self.size = len({b for _, b in self.n}) + 1
        self.options = {latin: [latin, *others] for latin, others in LOOK_ALIKE.items()}
        self.cache: dict[tuple[str, int | None], str] = {}
        self.learned = self.learn(strays)

    def log(self, a: str, b: str) -> float:
        return math.log((self.n.get((a, b), 0) + 0.1) / (self.first[a] + 0.1 * self.size))

    def learn(self, strays: list[tuple[str, str, int]]) -> dict[str, str]:
        """Latin letters that stray letters of other scripts are taken for.

        A letter that has no fixed look-alike and stands in words that its script can't write is set
        against every Latin letter of its case: by how likely that letter is in all the places where
        the stray stands. It is learned if there are enough places, one letter is far likelier than
        all others, and as likely as letters of the corpus are in theirs.
        """
        places: dict[str, list[tuple[str, str, int]]] = {}
        for a, b, n in strays:
            if b not in "^$" and not b.isascii() and script(b) != _LATIN:
                places.setdefault(b, []).append((a, "", n))
            if a not in "^$" and not a.isascii() and script(a) != _LATIN:
                places.setdefault(a, []).append(("", b, n))
        latin = [c for c in self.first if c.isascii() and c.isalpha()]
        total = sum(n for (a, b), n in self.n.items() if a.isascii() and b.isascii())
        usual = sum(n * self.log(a, b) for (a, b), n in self.n.items() if a.isascii() and b.isascii()) / total if total else 0.0
        out = {}
        for x, where in sorted(places.items()):
            # a place counts if its other letter is one that Latin writes
            where = [(a, b, n) for a, b, n in where if (a or b).isascii()]
            n = sum(k for *_, k in where)
            scores = sorted(((sum(k * (self.log(a, y) if a else self.log(y, b)) for a, b, k in where), y) for y in latin if y.isupper() == x.isupper()), reverse=True)
            if n >= 2 * LEARN_COUNT and len(scores) > 1 and scores[0][0] - scores[1][0] >= LEARN_MARGIN and scores[0][0] / n >= usual - LEARN_FIT:
                out[x] = scores[0][1]
        return out

    def cost(self, a: str, b: str) -> float:
        c = -self.log(a, b)
        if a != "^" and b != "$" and script(a) != script(b):
            c += SWITCH_COST
        return c

    def word(self, shape: str) -> str:
        """The cheapest reading of a word: a Viterbi path over the letters that each of its letters may stand for.

        A shape may be any letter of that shape; a letter without one is itself or what it was
        learned to look like. Letter pairs and changes of script decide: the same letter stays in a
        word of its own script and is read as its look-alike in a word of another.
        """
        letters = [i for i, c in enumerate(shape) if not unicodedata.combining(c)]
        lattice = [[(c, 0.0) for c in self.options.get(shape[i], [shape[i]])] + ([(self.learned[shape[i]], LEARNED_COST)] if shape[i] in self.learned else []) for i in letters]
        if all(len(x) == 1 for x in lattice):
            return shape
        best: list[tuple[float, str, int]] = [(0.0, "^", -1)]
        rows = [best]
        for ways in lattice:
            now = []
            for c, extra in ways:
                cost, k = min((cost + self.cost(prev, c), k) for k, (cost, prev, _) in enumerate(best))
                now.append((cost + extra, c, k))
            best = now
            rows.append(best)
        k = min(range(len(best)), key=lambda x: (best[x][0] + self.cost(best[x][1], "$"), x))
        out = list(shape)
        for i, row in zip(reversed(letters), reversed(rows[1:]), strict=True):
            out[i], k = row[k][1], row[k][2]
        return "".join(out)

    def read(self, shape: str, context: int | None) -> str:
        """A word's reading: in the one script that can write it, if it has letters of its own; a word of shapes only in the script of the text around it; else the cheapest path."""
        key = (shape, context)
        got = self.cache.get(key)
        if got is None:
            own = own_scripts(shape)
            got = None
            if not own:
                got = self.in_script(shape, context)
            elif len(own) == 1:
                got = self.in_script(shape, next(iter(own)))
            got = got or self.word(shape)
            if len(shape) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_WORDS:
                    self.cache.clear()
                self.cache[key] = got
        return got

    def in_script(self, shape: str, kind: int | None) -> str | None:
        if kind is None:
            return None
        out = []
        for c in shape:
            if not unicodedata.combining(c):
                c = writable(c, kind)
                if c is None:
                    return None
            out.append(c)
        return "".join(out)

    def form(self, text: str | None) -> str | None:
        if not text:
            return text
        shape = clean(text).translate(_TO_SHAPE)
        context = context_script(shape)
        if context == _LATIN and shape.isascii():
            return shape  # every word can be written in the script of the text, and is
        out = _WORD.sub(lambda m: self.read(m[0], context), shape)
        return out if out.isascii() else unicodedata.normalize("NFC", out).translate(_BACK)


def context_script(shape: str) -> int | None:
    """The script of most letters that tell it; None in a text without such letters."""
    latin = len(_OWN_LATIN.findall(shape))
    if shape.isascii():
        return _LATIN if latin else None
    own = Counter(script(c) for c in _OWN_OTHER.findall(shape))
    most, n = max(own.items(), key=lambda x: (x[1], -x[0]), default=(None, 0))
    return most if n > latin else _LATIN if latin else None


_OWN_OTHER = re.compile("[\u0370-\u058f\u1400-\u167f\u1f00-\u1fff\u2d30-\u2d7f\ua4d0-\ua4ff]")
#: Latin letters that neither Cyrillic nor Greek writes.
_OWN_LATIN = re.compile("[" + "".join(c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" if writable(c, _CYRILLIC) is None and writable(c, _GREEK) is None) + "]")


def with_form(df: DataFrame, text: str = "text", out: str = "form", statistics: DataFrame | None = None) -> DataFrame:
    """``df`` and the one form of its text column.

    A word gets the one script that can write it, a word of look-alikes only the script of the text
    around it; where no script can, the whole corpus' letter pairs (``statistics``: the texts to
    count, ``df`` itself by default) decide which letters stand for others (``Forms.word``), also
    such as are not in the fixed table but were learned from the corpus; width forms, ligatures, blanks,
    hyphens, line ends and accents are written one way; characters that can't be seen are deleted,
    but for joiners that shape an emoji or a letter. Null stays null, empty stays empty, a text of
    unseen characters only becomes empty. Two texts get one form if they differ in such characters only.
    The pair counts collected are bounded by twice the square of the alphabets (some ten thousand rows in practice) and go to the workers as one broadcast.
    """
    pairs = [tuple(r) for r in letter_pairs(statistics if statistics is not None else df, text).collect()]
    shared = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, pairs))

    def forms_of(texts: pa.Array) -> pa.Array:
        forms = _forms(shared)
        return pa.array([forms.form(t) for t in texts.to_pylist()], pa.string())

    # not to be copied into a filter on the form and made twice
    form = F.arrow_udf(forms_of, "string").asNondeterministic()
    return df.withColumn(out, form(F.col(f"`{text}`")))


_READY: dict[str, Forms] = {}


def _forms(shared) -> Forms:
    token, pairs = shared.value
    if token not in _READY:
        _READY.clear()
        _READY[token] = Forms(pairs)
    return _READY[token]


def same_looking_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key_a, key_b)``, a < b: rows whose texts differ in code points but have one form.

    Forms are compared by their SHA-256 digest, so only keys and digests are shuffled. A digest
    with one writing only drops out in a combined aggregation before anything is paired; what is
    left are the true pairs, so the work follows the result. Rows with a null key or text, and
    texts with no visible character, are in no pair; repeated rows of a key count once.
    """
    formed = with_form(df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).filter("k is not null and t is not null"), "t", "form")
    seen = formed.filter(F.col("form").rlike(r"[^\s\p{Z}\p{C}⠀]"))
    marks = seen.select("k", F.sha2("form", 256).alias("form"), F.xxhash64("t").alias("w"), F.crc32(F.col("t").cast("binary")).alias("w2"))
    path = scratch_path(df.sparkSession, "forms")
    marks.write.parquet(path)  # the forms are read twice below, and must be made once
    marks = df.sparkSession.read.parquet(path)
    many = marks.groupBy("form").agg(F.min("w").alias("a"), F.max("w").alias("b"), F.min("w2").alias("c"), F.max("w2").alias("d")).filter("a <> b or c <> d").select("form")
    left = marks.join(many, "form", "left_semi")
    a, b = left.alias("a"), left.alias("b")
    on = (F.col("a.form") == F.col("b.form")) & (F.col("a.k") < F.col("b.k")) & ((F.col("a.w") != F.col("b.w")) | (F.col("a.w2") != F.col("b.w2")))
    return a.join(b, on).select(F.col("a.k").alias(f"{key}_a"), F.col("b.k").alias(f"{key}_b")).distinct()
