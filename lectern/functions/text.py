"""Scalar functions on text as column expressions. All stay inside codegen except
``fold_key``, for which Spark has no Unicode decomposition."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word characters in the sense of Unicode, as both Java and RE2 spell them.
NOT_WORD = r"[^\p{L}\p{M}\p{N}_]+"


@F.pandas_udf(T.StringType())
def fold_key(s: pd.Series) -> pd.Series:
    """Key folding: decompose, drop marks, lower, delete all but word characters and
    spaces, collapse spaces."""

    def fold(x: str | None) -> str | None:
        if x is None:
            return None
        kept = "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)).lower()
        return " ".join("".join(c for c in kept if c.isalnum() or c == "_" or c.isspace()).split())

    return s.map(fold)


@F.pandas_udf(T.StringType())
def without_marks(s: pd.Series) -> pd.Series:
    """Decomposed, without combining marks."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"))


def fold_latin(c: Column) -> Column:
    """``fold_key`` for Latin letters, as a built-in expression."""
    marked = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīłńňōőřśšťūůűźżž"
    plain = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegilnnoorsstuuuzzz"
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(c), marked, plain), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def chunk_windows(docs: DataFrame, size: int = 1000) -> DataFrame:
    """Fixed character windows with offsets, the last one clipped. An empty text has none.
    One pass over the text; rows carry their window only."""
    keep = [c for c in docs.columns if c != "text"]
    out = docs.select(*keep, F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).alias("chunk_index", "text"))
    start = F.col("chunk_index") * size
    return out.select(*keep, F.concat(F.lit("c"), F.col("chunk_index").cast("string")).alias("chunk_id"), "chunk_index", "text", start.alias("start_char"), (start + F.char_length("text")).alias("end_char"))


def words(c: Column) -> Column:
    """Lower-cased words."""
    return F.filter(F.split(F.lower(c), NOT_WORD), lambda w: w != "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def normalize_doi(c: Column) -> Column:
    """Lower case, without a resolver address and a ``doi:`` prefix."""
    low = F.lower(F.trim(c))
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(low, r"^https?://(dx\.)?doi\.org/", ""), r"^doi:\s*", "")), F.lit(""))


def alias_key(surname: Column, year: Column, title: Column) -> Column:
    """Folded surname, year or 'unknown', first 40 characters of the folded title."""
    return F.concat_ws("|", fold_key(F.coalesce(surname, F.lit(""))), F.coalesce(year.cast("string"), F.lit("unknown")), F.left(fold_key(F.coalesce(title, F.lit(""))), F.lit(40)))


def surrogate_id(surname: Column, year: Column, title: Column) -> Column:
    return F.concat(F.lit("key:"), alias_key(surname, year, title))


def chunk_ordinal(c: Column) -> Column:
    """Ordinal at the end of a chunk id, -1 if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(\d+)$", 1), F.lit("")).try_cast("int"), F.lit(-1))


def count_substring(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences, case folded; an empty term occurs nowhere."""
    low, what = F.lower(text), F.lower(term)
    n = (F.char_length(low) - F.char_length(F.replace(low, what, F.lit("")))) / F.char_length(what)
    return F.when(F.char_length(what) > 0, n.cast("int")).otherwise(0)


def preview(c: Column, limit: int = 200) -> Column:
    """At most ``limit`` characters, cut at the last space, with an ellipsis."""
    head = F.rtrim(F.regexp_replace(F.substring(c, 1, limit), r"\s+\S*\z", ""))
    return F.when(F.char_length(c) <= limit, c).otherwise(F.concat(head, F.lit("…")))


_PARTICLES = "van|von|de|der|den|du|da|di|la|le|del|della|dos|ter|ten"


def surname_of(display: Column) -> Column:
    """Surname with its particles from 'Forename Surname' or 'Surname, Forename'."""
    clean = F.trim(F.regexp_replace(display, r"\s+", " "))
    comma = F.trim(F.substring_index(clean, ",", 1))
    tail = F.regexp_extract(clean, rf"(?i)((?:\b(?:{_PARTICLES})\s+)*\S+)$", 1)
    return F.when(F.instr(clean, ",") > 0, comma).otherwise(tail)


def forename_of(display: Column) -> Column:
    clean = F.trim(F.regexp_replace(display, r"\s+", " "))
    after = F.trim(F.regexp_replace(clean, r"^[^,]*,", ""))
    before = F.trim(F.left(clean, F.char_length(clean) - F.char_length(surname_of(display))))
    return F.when(F.instr(clean, ",") > 0, after).otherwise(before)


def authorship(c: Column) -> Column:
    """struct(surnames, year) of an authorship string such as '(Totton & Fraser, 1955)'."""
    year = F.nullif(F.regexp_extract(c, r"(1[6-9]\d\d|20\d\d)", 1), F.lit("")).try_cast("int")
    names = F.regexp_replace(F.regexp_replace(c, r"[()\[\]]", ""), r",?\s*\d{4}.*$", "")
    parts = F.split(names, r"\s*(?:&|,|\band\b|\bet\b)\s*")
    bare = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\b\p{Lu}\.\s*", "")))
    return F.struct(F.filter(bare, lambda p: (p != "") & (F.lower(p) != "al.")).alias("surnames"), year.alias("year"))


#: Leading surname and the first four digits after it (fixed value).
FILENAME = r"^([A-Za-zÀ-ÿ]+)[^0-9]*?(\d{4})"


def from_filename(name: Column) -> Column:
    """struct(surname, year) of names like Totton1965a.pdf. A name without such digits has
    neither; a year outside 1600 to 2100 is null."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*$", "")
    surname, year = (F.nullif(F.regexp_extract(stem, FILENAME, k), F.lit("")) for k in (1, 2))
    year = year.try_cast("int")
    return F.struct(surname.alias("surname"), F.when(year.between(1600, 2100), year).alias("year"))


def year_in_filename(name: Column) -> Column:
    """First year from 1700 to 2049 that is no part of a longer number."""
    return F.nullif(F.regexp_extract(name, r"(?<!\d)(1[789]\d\d|20[0-4]\d)(?!\d)", 1), F.lit("")).try_cast("int")


def ascii_surname(c: Column) -> Column:
    """Letters and digits of a surname without marks, case kept; 'Anon' for none."""
    return F.coalesce(F.nullif(F.regexp_replace(without_marks(c), "[^A-Za-z0-9]+", ""), F.lit("")), F.lit("Anon"))


def year_or_nodate(year: Column) -> Column:
    return F.coalesce(year.cast("string"), F.lit("nodate"))


def alpha_suffix(n: Column) -> Column:
    """0: none, 1: a, 26: z, 27: aa, 703: aaa and so on, for any long."""
    step = lambda st, _: F.when(st["n"] <= 0, st).otherwise(F.struct(F.floor((st["n"] - 1) / 26).cast("bigint").alias("n"), F.concat(F.char(F.lit(97) + F.pmod(st["n"] - 1, F.lit(26))), st["out"]).alias("out")))
    # 14 letters are enough for 2 ** 63.
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.struct(n.cast("bigint").alias("n"), F.lit("").alias("out")), step)["out"]


#: Well-formed Roman numerals up to 4999 (fixed value).
ROMAN = r"(?i)^m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"


def roman(c: Column) -> Column:
    """Value of a well-formed Roman numeral, null for anything else."""
    value = F.create_map(*[F.lit(x) for pair in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in pair])
    clean = F.upper(F.trim(c))
    letters = F.transform(F.split(clean, ""), lambda ch: value[ch])
    folded = F.aggregate(F.reverse(letters), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda s, v: F.struct((s["sum"] + F.when(v < s["last"], -v).otherwise(v)).alias("sum"), v.alias("last")))
    return F.when((clean != "") & clean.rlike(ROMAN), folded["sum"])


#: What a figure is called in captions and texts (fixed value).
FIGURE_PREFIX = (
    r"fig(?:ure|\.?)|abb(?:ildung|\.?)|pl(?:ate|\.?)|plate|рис(?:унок|\.?)"
    r"|image|illustration|lám(?:ina|\.?)|tav(?:ola|\.?)|bild"
    r"|text[\-\s]?fig(?:ure|\.?)"
    r"|taf(?:el|\.?)|tab(?:ula|\.?)"
)


def figure_number(caption: Column) -> Column:
    """Number at the head of a caption in several languages, with a letter or a decimal;
    Roman ones as digits, letters that are no numeral as they are."""
    head = rf"(?iu)^\s*(?:{FIGURE_PREFIX})\s*(\d+(?:\.\d+)?[a-z]?|[IVXLCDM]+\b)"
    found = F.nullif(F.regexp_extract(caption, head, 1), F.lit(""))
    return F.coalesce(roman(found).cast("string"), found)


def letter_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{L}"))


def stopword_free(c: Column, stopwords: list[str]) -> Column:
    return ~F.lower(c).isin(stopwords)


#: Writing systems by ranges of code points, ends inclusive (fixed values).
SCRIPTS = {
    "latin": [(0x0000, 0x024F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F)],
    "cyrillic": [(0x0400, 0x052F)],
    "greek": [(0x0370, 0x03FF)],
    "arabic": [(0x0600, 0x06FF)],
}


@lru_cache(maxsize=1)
def _script_classes() -> np.ndarray:
    """For every code point: 0 no letter, 1 another letter, else a script's number."""
    kind = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint8, 0x110000)
    for k, ranges in enumerate(SCRIPTS.values(), 2):
        for low, high in ranges:
            kind[low : high + 1] = np.where(kind[low : high + 1] > 0, k, 0)
    return kind


def script_counts(c: Column) -> Column:
    """struct(letters, latin, cyrillic, greek, arabic): letters of each system, and all.
    One pass over the code points of a batch."""

    @F.pandas_udf("letters long, " + ", ".join(f"{k} long" for k in SCRIPTS))  # a session exists here
    def counts(s: pd.Series) -> pd.DataFrame:
        classes, rows = _script_classes(), []
        for x in s:
            n = np.bincount(classes[np.frombuffer((x or "").encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=2 + len(SCRIPTS))
            rows.append((int(n[1:].sum()), *map(int, n[2:])))
        return pd.DataFrame(rows, columns=["letters", *SCRIPTS])

    return counts(c)


#: White space that separates tokens, and what is stripped from their ends (fixed values).
TOKEN_SPACE = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
TOKEN_EDGE = ".,;:!?()[]{}\"'"


def suspicious_share(c: Column) -> Column:
    """Share of tokens, punctuation stripped, of at most two characters, all digits, or
    with digits and letters. 0 for a text without tokens."""
    bare = F.transform(F.split(c, TOKEN_SPACE), lambda t: F.btrim(t, F.lit(TOKEN_EDGE)))
    tokens = F.filter(bare, lambda t: t != "")
    odd = lambda t: (F.char_length(t) <= 2) | (t.rlike(r"\p{Nd}") & (t.rlike(r"\p{L}") | t.rlike(r"^\p{Nd}+$")))
    # One array of tokens for both counts.
    share = F.transform(F.array(tokens), lambda ts: F.when(F.size(ts) > 0, F.size(F.filter(ts, odd)) / F.size(ts)).otherwise(0.0))
    return F.coalesce(share[0], F.lit(0.0))


#: Section classes by pattern, first match wins (fixed values, in five languages).
SECTIONS = [
    ("abstract", r"\babstract\b|\bsummary\b|\bzusammenfassung\b|\br[ée]sum[ée]\b|резюме|сводка"),
    ("introduction", r"\bintroduction\b|\bвведение\b|\beinleitung\b"),
    ("methods", r"materials?\s+and\s+methods|\bmethods?\b|\bmethodology\b|study\s+area|материалы\s+и\s+методы|m[ée]thodes"),
    ("results", r"\bresults?\b|\bр[еé]зультаты\b|\bergebnisse\b|\br[ée]sultats\b"),
    ("description", r"\bdescription\b|\bsystematics?\b|\btaxonomy\b|\bsystematic\s+account\b|\bdiagnosis\b|описание"),
    ("discussion", r"\bdiscussion\b|обсуждение|\bdiskussion\b"),
    ("conclusion", r"\bconclusions?\b|выводы|\bschlussfolgerung"),
    ("acknowledgements", r"acknowledg(?:e?ment)s?|благодарности|danksagung|remerciements"),
    ("references", r"\breferences?\b|\bbibliograph|\bliterature\s+cited\b|литература"),
    ("appendix", r"\bappendix\b|приложение|anhang"),
]


def section_class(headings: Column) -> Column:
    """Class of the most specific heading in which a pattern is found, null if none is."""
    classify = lambda h: F.coalesce(*[F.when(F.lower(h).rlike("(?U)" + p), F.lit(k)) for k, p in SECTIONS])
    hits = F.filter(F.transform(F.reverse(headings), classify), lambda x: x.isNotNull())
    return F.try_element_at(hits, F.lit(1))


def relative_path(c: Column, root: str) -> Column:
    top = root.rstrip("/") + "/"
    return F.when(c.startswith(top), F.right(c, F.char_length(c) - len(top))).otherwise(c)


def absolute_path(c: Column) -> Column:
    """Whether a string looks like an absolute path."""
    return c.rlike(r"^(/[^/ ]+/|[A-Za-z]:\\)")


def element_text(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\s+", " ")


def outer_json(c: Column) -> Column:
    """Outermost JSON object in a free text (first to last brace), null if there is none or
    it is malformed."""
    found = F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.when(F.json_object_keys(found).isNotNull(), found)


def box_area(b: Column) -> Column:
    """Area of struct(x0, y0, x1, y1); an inverted box has none."""
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def box_overlap(a: Column, b: Column) -> Column:
    """Intersection over the smaller area."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    least = F.least(box_area(a), box_area(b))
    return F.when(least > 0, F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h) / least).otherwise(0.0)


def structured_chunks(elements: DataFrame, size: int = 1000) -> DataFrame:
    """Chunks of whole paragraphs with their heading trail, at most ``size`` characters
    unless one paragraph is longer. elements: doc_id, seq, level (of a heading, else
    null), text. A heading ends the chunk before it; one document is one task's work."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, trail, held = [], {}, []

        def close() -> None:
            if held:
                out.append((pdf["doc_id"].iloc[0], f"c{len(out)}", len(out), [trail[k] for k in sorted(trail)], "\n".join(held)))
                held.clear()

        for e in pdf.sort_values("seq").itertuples():
            if not pd.isna(e.level):
                close()
                trail = {k: v for k, v in trail.items() if k < e.level} | {e.level: e.text}
            elif e.text:
                if held and sum(map(len, held)) + len(held) + len(e.text) > size:
                    close()
                held.append(e.text)
        close()
        return pd.DataFrame(out, columns=["doc_id", "chunk_id", "chunk_index", "headings", "text"])

    return elements.groupBy("doc_id").applyInPandas(run, "doc_id long, chunk_id string, chunk_index int, headings array<string>, text string")


#: Recogniser packs by language and by script (fixed values).
PACKS = {
    "en": "eng", "de": "deu", "fr": "fra", "la": "lat", "it": "ita", "es": "spa", "pt": "por", "nl": "nld", "pl": "pol", "sv": "swe",
    "no": "nor", "da": "dan", "fi": "fin", "ca": "cat", "cs": "ces", "hu": "hun", "ro": "ron", "sk": "slk", "sl": "slv", "hr": "hrv",
    "et": "est", "lv": "lav", "lt": "lit", "sq": "sqi", "cy": "cym", "af": "afr", "id": "ind", "sw": "swa", "tl": "tgl", "vi": "vie",
    "tr": "tur", "ru": "rus", "uk": "ukr", "bg": "bul", "mk": "mkd", "el": "ell", "ar": "ara", "fa": "fas", "ur": "urd", "he": "heb",
    "hi": "hin", "mr": "mar", "ne": "nep", "bn": "ben", "gu": "guj", "pa": "pan", "ta": "tam", "te": "tel", "kn": "kan", "ml": "mal",
    "th": "tha", "ja": "jpn", "ko": "kor", "zh-cn": "chi_sim", "zh-tw": "chi_tra",
}
SCRIPT_PACKS = {
    "Cyrillic": ["rus"], "Greek": ["ell"], "Fraktur": ["deu_latf", "deu"], "Arabic": ["ara"], "Hebrew": ["heb"], "Devanagari": ["hin"],
    "Japanese": ["jpn"], "Hangul": ["kor"], "Han": ["chi_sim", "chi_tra"], "Thai": ["tha"], "Bengali": ["ben"], "Tamil": ["tam"],
    "Telugu": ["tel"], "Kannada": ["kan"], "Malayalam": ["mal"], "Gujarati": ["guj"], "Gurmukhi": ["pan"],
}
DEFAULT_PACKS = ["eng", "deu", "deu_latf", "fra", "rus", "lat"]


def recogniser_packs(iso: Column, script: Column, installed: list[str] | None = None) -> Column:
    """Packs of a known script, whatever the language; else of the language (German with
    its black-letter pack); else the default union. English comes last. ``installed``
    restricts them; without one it is every pack named here."""
    have = sorted({*PACKS.values(), *(p for ps in SCRIPT_PACKS.values() for p in ps), *DEFAULT_PACKS}) if installed is None else installed
    names = lambda ps: F.array(*[F.lit(p) for p in ps if p in have]).cast("array<string>")
    table = lambda m: F.create_map(*[x for k, ps in m.items() for x in (F.lit(k), names(ps))])
    languages = {k: [v, "deu_latf"] if v == "deu" and "deu" in have else [v] for k, v in PACKS.items()}
    by_script = table(SCRIPT_PACKS)[script]
    chosen = F.when(by_script.isNotNull(), by_script).otherwise(F.coalesce(table(languages)[iso], names([])))
    english = names(["eng"])
    union = F.array_union(names(DEFAULT_PACKS), english)
    return F.when(F.size(chosen) > 0, F.array_union(chosen, english)).otherwise(union)


#: Marks of a vendor's cover page in place of a text layer (fixed values).
VENDOR_MARKS = ("ProQuest ebrary", "biodiversitylibrary.org", "This page intentionally left blank")


def vendor_banner(c: Column, most: int = 5000) -> Column:
    """Whether a text is little more than a vendor's banner."""
    marked = F.lit(False)
    for m in VENDOR_MARKS:
        marked |= F.contains(c, F.lit(m))
    return marked & (F.char_length(c) < most)


def json_strings(c: Column) -> Column:
    """All string leaves of a JSON text, in order of appearance; null for malformed JSON."""

    @F.pandas_udf("array<string>")  # a session exists here
    def leaves(s: pd.Series) -> pd.Series:
        def walk(x, out: list) -> list:
            for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
                walk(y, out)
            if isinstance(x, str):
                out.append(x)
            return out

        def one(text: str | None) -> list | None:
            try:
                return None if text is None else walk(json.loads(text), [])
            except ValueError:
                return None

        return s.map(one)

    return leaves(c)
