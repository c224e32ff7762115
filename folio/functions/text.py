"""Text functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig

DIGITS = "[0-9]+"
HOLE = "⟦N([0-9]+)⟧"
BLANKS = r"[ \t\n\x0b\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CJK = r"[\x{4e00}-\x{9fff}]"
WIDE_CJK = r"[\x{3000}-\x{303f}\x{4e00}-\x{9fff}\x{ff00}-\x{ffef}]"
# fixed value: the characters of symbolic text
SYMBOLS = r"[0-9\s.,\-–—°×/%≥≤<>+=()^\[\]{}|±·∙∕'\"^~:;?!*&#$_A-Za-zÅÄÉÈÑÖÜαβγδεθλμπσΔΩ≈≡‘’“”]*"
# fixed value: characters that come from wrong font tables, with what they stand for
LIGATURES = {"ð": "(", "Þ": ")", "Ɵ": "ti", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "\u00ad": ""}


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, f"^{BLANKS}+|{BLANKS}+$", "")


def collapse_blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{BLANKS}+", " "))


def norm_key(c: Column, length: int = DEFAULT.key_length) -> Column:
    """What recurring texts share: no digits, plain spaces, the first characters."""
    return F.left(F.regexp_replace(F.replace(c, F.lit("\u00a0"), F.lit(" ")), DIGITS, ""), F.lit(length))


def digit_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(DIGITS), F.lit(0))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not again in every lambda call that uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _joined(pieces: Column, holes: Column, fill) -> Column:
    """The first piece, then ``fill(hole, i)`` and the piece behind it for each hole."""
    pairs = lambda p: F.zip_with(holes, F.slice(p, F.lit(2), F.size(p) - 1), lambda h, q: F.struct(h.alias("h"), q.alias("q")))
    return let(pieces, lambda p: F.concat(F.element_at(p, 1), F.array_join(F.transform(pairs(p), lambda z, i: F.concat(fill(z["h"], i), z["q"])), "")))


def number_runs(c: Column, only: Column | None = None) -> Column:
    """Each digit run as ``⟦Ni⟧``, i counting runs from 0; ``only``: an array of the i to replace."""

    def fill(x: Column, i: Column) -> Column:
        hole = F.concat(F.lit("⟦N"), i.cast("string"), F.lit("⟧"))
        return hole if only is None else F.when(F.array_contains(only, i), hole).otherwise(x)

    return _joined(F.split(c, DIGITS, -1), digit_runs(c), fill)


def signature(c: Column) -> Column:
    """Numbered text with all holes alike."""
    return F.regexp_replace(c, HOLE, "#")


def digit_mask(c: Column) -> Column:
    return F.regexp_replace(c, DIGITS, "#")


def _holes(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(HOLE), F.lit(1))


def restore_runs(c: Column, source: Column, blank: bool = False) -> Column:
    """Put the source's digit runs into the holes; holes without one stay, or are blanked."""

    def filled(runs: Column) -> Column:
        def fill(x: Column, i: Column) -> Column:
            return F.coalesce(F.try_element_at(runs, x.cast("int") + 1), F.lit("") if blank else F.concat(F.lit("⟦N"), x, F.lit("⟧")))

        return _joined(F.split(c, HOLE, -1), _holes(c), fill)

    # most texts have no hole and are done
    return F.when(c.contains("⟦N"), let(digit_runs(source), filled)).otherwise(c)


def remap_runs(c: Column, holes: Column) -> Column:
    """Renumber holes by a map of int to int; unmapped ones keep their number."""
    to = lambda x: F.coalesce(F.try_element_at(holes, x.cast("int")), x.cast("int"))
    return _joined(F.split(c, HOLE, -1), _holes(c), lambda x, i: F.concat(F.lit("⟦N"), to(x).cast("string"), F.lit("⟧")))


def permute_lines(c: Column, order: Column) -> Column:
    """Lines in the given order (0-based), if it has as many entries as there are lines."""

    def moved(lines: Column) -> Column:
        text = F.array_join(F.transform(order, lambda i: F.try_element_at(lines, i.cast("int") + 1)), "\n")
        return F.when(F.size(order) == F.size(lines), text).otherwise(c)

    return let(F.split(c, "\n", -1), moved)


def replace_words(c: Column, words: dict[str, str]) -> Column:
    """Whole-word replacements in the given order; the border is asked for beside word characters only."""
    for word, to in words.items():
        c = F.regexp_replace(c, word_pattern(word), literal(to))
    return c


def _quoted(word: str) -> str:
    return "".join("\\" + ch if not (ch.isalnum() or ch.isspace() or ord(ch) > 127) else ch for ch in word)


def word_pattern(word: str) -> str:
    """A whole word as a pattern; letters of all scripts are word characters."""
    border = lambda ch: r"\b" if ch.isalnum() or ch == "_" else ""
    return f"(?U:{border(word[:1])}{_quoted(word)}{border(word[-1:])})"


def class_member(ch: str) -> str:
    """One character inside ``[...]``."""
    return "\\" + ch if ch in "\\[]^-&" else ch


def literal(to: str) -> str:
    """A replacement without references to groups."""
    return to.replace("\\", "\\\\").replace("$", "\\$")


def has_word(c: Column, word: str) -> Column:
    return c.contains(word) & c.rlike(word_pattern(word))


def toc_mark(c: Column, parity: bool = DEFAULT.toc_parity) -> Column:
    """Contents lines as ``title ⟦P12⟧``, line by line; ``parity`` leaves part of a long dot leader in the title."""
    title = r"^(.*\S)[\s.]{6,}([0-9]{1,4})\s*$" if parity else r"^(.*[^\s.])[\s.]{6,}([0-9]{1,4})\s*$"
    alone = r"^(.*)[\s.]{6,}([0-9]{1,4})\s*$" if parity else r"^[\s.]{6,}([0-9]{1,4})\s*$"

    def marked(s: Column, x: Column) -> Column:
        number = F.concat(F.lit("⟦P"), F.regexp_extract(s, r"([0-9]{1,4})\s*$", 1), F.lit("⟧"))
        return (F.when(s.rlike(title), F.concat(F.trim(F.regexp_extract(s, title, 1)), F.lit(" "), number))
                .when(s.rlike(alone), number).otherwise(x))

    def line(x: Column) -> Column:
        # few lines end in a number: only those are matched in full
        return F.when(x.rlike(rf"[0-9]{BLANKS}*$"), let(strip(x), lambda s: marked(s, x))).otherwise(x)

    return F.array_join(F.transform(F.split(c, "\n", -1), line), "\n")


def is_symbolic(c: Column, runs: bool = False) -> Column:
    """Formula debris: no CJK, no Latin word of four letters, only symbol characters.

    ``runs``: one character repeated four times or more also counts, before the word test.
    """
    s, word = strip(c), c.rlike("[A-Za-z]{4,}")
    clean = (s != "") & ~c.rlike(CJK)
    # the test that fails for most texts comes first
    out = ~word & clean & s.rlike(f"^(?:{SYMBOLS})$")
    if runs:
        out = out | (clean & s.rlike(r"^(.)\1{3,}$"))
    return F.coalesce(out, F.lit(False))


def is_heading(text: Column, bold: Column, size: Column, cfg: EngineConfig = DEFAULT) -> Column:
    return (bold | (size >= cfg.heading_min_size)) & strip(text).rlike(cfg.heading_pattern)


def starts_with_any(c: Column, prefixes: Sequence[str]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | c.startswith(p)
    return found


def is_kept(c: Column, cfg: EngineConfig = DEFAULT) -> Column:
    return starts_with_any(strip(c), cfg.keep_prefixes)


def ends_sentence(c: Column, cfg: EngineConfig = DEFAULT) -> Column:
    return strip(c).rlike(cfg.terminal_pattern)


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def has_wide_cjk(c: Column) -> Column:
    return c.rlike(WIDE_CJK)


def has_escape_residue(c: Column) -> Column:
    return c.rlike(r"\\[ntrfv0]")


def normalise_ligatures(c: Column) -> Column:
    for bad, good in LIGATURES.items():
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def cjk_spacing(c: Column) -> Column:
    """A space between CJK and Latin letters or digits, and full-width marks after CJK."""
    c = F.regexp_replace(c, f"(?<={CJK})(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])(?={CJK})", " ")
    for half, full in ((",", "，"), (";", "；"), (":", "："), ("!", "！"), (r"\?", "？")):
        c = F.regexp_replace(c, f"(?<={CJK}){half}", full)
    return c


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"\.[^.]*$", "")


def chunk_label(doc: Column, chunk: Column) -> Column:
    return F.concat(doc.cast("string"), F.lit("_c"), F.lpad(chunk.cast("string"), F.greatest(F.lit(2), F.length(chunk.cast("string"))), "0"))


def doc_of_label(label: Column) -> Column:
    """What stands before the last ``_c``."""
    return F.regexp_replace(label, "_c(?!.*_c).*$", "")


def crop_spec(c: Column) -> Column:
    """``PAGE:x0,y0,x1,y1`` as a struct; null if malformed."""
    number = r"(-?[0-9]+(?:\.[0-9]+)?)"
    form = rf"^([0-9]+):{number},{number},{number},{number}$"
    part = lambda i, kind: F.regexp_extract(c, form, i).cast(kind)
    return F.when(c.rlike(form), F.struct(part(1, "int").alias("page"), part(2, "double").alias("x0"), part(3, "double").alias("y0"), part(4, "double").alias("x1"), part(5, "double").alias("y1")))


def rgb(packed: Column) -> Column:
    """A 24-bit colour as shares of red, green and blue."""
    part = lambda shift: F.shiftright(packed, shift).bitwiseAND(255) / 255.0
    return F.struct(part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))
