"""Column builders for text: trimming, keys, names, paths. A blank text and a missing one are the same value, null."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as spreadsheets and web forms leave it: SQL's trim only knows the space.
WHITE = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
AUDIO_FILE = r"(?i)\.(wav|flac|aiff?|mp3|m4a|aac|ogg)$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """The text without white space at its ends; null stays null, blank becomes the empty text."""
    return F.regexp_replace(col(c), f"^[{WHITE}]+|[{WHITE}]+$", "")


def clean(c: Column | str) -> Column:
    """F01. trimmed, with null for blank."""
    return F.nullif(trimmed(col(c).cast("string")), F.lit(""))


def blank(c: Column | str) -> Column:
    """Whether a value is missing or blank."""
    return clean(c).isNull()


def pick(*candidates: Column | str) -> Column:
    """P01. The first candidate that isn't blank, as it stands, spaces included."""
    return F.coalesce(*[F.when(~blank(c), col(c)) for c in candidates])


def isrc_key(c: Column | str) -> Column:
    """F05. Recording code: upper case, no white space; hyphens stay."""
    return F.nullif(F.upper(F.regexp_replace(col(c), f"[{WHITE}]+", "")), F.lit(""))


def isrc_lookup(c: Column | str) -> Column:
    """Recording code as lookups compare it: trimmed, upper case."""
    return F.upper(clean(c))


def catalogue_key(c: Column | str) -> Column:
    """F06. Catalogue number in lower case without white space, hyphens and underscores."""
    return F.nullif(F.regexp_replace(F.lower(trimmed(c)), rf"[{WHITE}\-_]+", ""), F.lit(""))


def loose_key(c: Column | str) -> Column:
    """F07. Catalogue number in lower case, letters a-z and digits only."""
    return F.nullif(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", ""), F.lit(""))


def title_key(c: Column | str) -> Column:
    """F08. Title in lower case, letters a-z and digits only: accented letters go. Null counts as empty."""
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", "")


def _accents() -> tuple[str, str]:
    """Accented letters and their base letters, from Unicode's own decompositions."""
    found = {}
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(c))
        if len(base) > 1 and all(unicodedata.combining(x) for x in base[1:]):
            found[chr(c)] = base[0]
    return "".join(found), "".join(found.values())


ACCENTED, PLAIN = _accents()


def without_accents(c: Column | str) -> Column:
    """Base letters for accented ones, composed or not."""
    return F.regexp_replace(F.translate(col(c), ACCENTED, PLAIN), r"[\u0300-\u036F]", "")


def title_words(c: Column | str) -> Column:
    """F09. Title or file name for matching: no audio extension, no accents, words of a-z and digits with single spaces."""
    name = F.regexp_replace(F.coalesce(col(c), F.lit("")), AUDIO_FILE, "")
    return F.trim(F.regexp_replace(F.lower(without_accents(name)), "[^a-z0-9]+", " "))


def search_key(c: Column | str) -> Column:
    """F10. Trimmed, lower case, single spaces; null counts as empty."""
    return F.regexp_replace(F.lower(trimmed(F.coalesce(col(c), F.lit("")))), f"[{WHITE}]+", " ")


def similarity(a: Column | str, b: Column | str) -> Column:
    """F11, F12. 1 - edit distance / longer length of two title keys; 1 if both are empty."""
    x, y = title_key(a), title_key(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longest)


def may_reach(a: Column | str, b: Column | str, tenths: int = 7) -> Column:
    """Whether two keys are close enough in length for a similarity of tenths / 10. Lossless, and cheap to test first."""
    x, y = F.length(title_key(a)), F.length(title_key(b))
    return 10 * F.abs(x - y) <= (10 - tenths) * F.greatest(x, y)


def split_names(c: Column | str, marks: str = "[;,|]") -> Column:
    """F25. Names between marks, trimmed, no blanks, each once, in order; no names for null."""
    parts = F.transform(F.split(F.coalesce(col(c).cast("string"), F.lit("")), marks), lambda x: trimmed(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def numbered_names(columns: list[str], prefix: str, most: int = 4) -> Column:
    """F26. Names from prefix, prefix 1, prefix 2 ... in that order, of the columns that exist; the first spelling of each, whatever its case."""
    slots = [f"{prefix} 1", f"{prefix}1", prefix, *[f"{prefix}{gap}{n}" for n in range(2, most + 1) for gap in (" ", "")]]
    held = [clean(F.col(f"`{s}`")) for s in slots if s in columns]
    if not held:
        return F.array().cast("array<string>")
    return first_spellings(F.array_compact(F.array(*held)))


def first_spellings(names: Column) -> Column:
    """Names of an array, the first spelling of each whatever its case."""
    none = F.array().cast("array<string>")
    return F.aggregate(names, none, lambda out, x: F.when(F.exists(out, lambda y: F.lower(y) == F.lower(x)), out).otherwise(F.concat(out, F.array(x))))


def joined(names: Column, mark: str = "; ") -> Column:
    """F33. Trimmed names of an array as one text; null if there are none."""
    kept = F.filter(F.transform(names, lambda x: trimmed(x)), lambda x: x.isNotNull() & (x != ""))
    return F.nullif(F.array_join(kept, mark), F.lit(""))


def basename(c: Column | str) -> Column:
    """F32. What follows the last slash, of either kind."""
    return F.substring_index(F.regexp_replace(col(c), r"\\", "/"), "/", -1)


def stem(c: Column | str) -> Column:
    """F32. A name without its last extension."""
    return F.regexp_replace(col(c), r"\.[^.]+$", "")


def filename_key(c: Column | str) -> Column:
    """File name as linkage compares it: trimmed, lower case, no extension; null if blank."""
    return F.nullif(stem(F.lower(clean(c))), F.lit(""))


def title_of_filename(c: Column | str) -> Column:
    """F29. Title in Artist_Title_Number or Artist_Title; a name of one part is the title."""
    name = trimmed(stem(c))
    parts = F.filter(F.transform(F.split(name, "_"), lambda x: trimmed(x)), lambda x: x != "")
    return F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 2), " ")).when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(name)


def path_part(c: Column | str) -> Column:
    """F30. A name for an object key: letters, digits and underscores; 'Unknown' for null and empty."""
    kept = F.regexp_replace(F.coalesce(F.nullif(col(c), F.lit("")), F.lit("Unknown")), "[^a-zA-Z0-9 ]", "")
    return F.regexp_replace(F.trim(kept), " +", "_")


def folder_part(c: Column | str) -> Column:
    """F30. A name for a folder: no characters that file systems refuse, no dots or spaces at its ends."""
    kept = F.regexp_replace(trimmed(F.coalesce(col(c), F.lit(""))), r'[<>:"/\\|?*\x00-\x1f]', "")
    return F.regexp_replace(F.regexp_replace(kept, f"[{WHITE}]+", " "), f"^[{WHITE}.]+|[{WHITE}.]+$", "")


def download_name(c: Column | str, most: int = 180) -> Column:
    """F30. A file name to offer: refused characters become spaces, runs of spaces one."""
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(col(c), r'[\\/:*?"<>|\x00-\x1f]', " "), f"[{WHITE}]+", " ")), F.lit(most))


def asset_part(c: Column | str) -> Column:
    """F30. A name for an asset number: other characters than letters, digits, _ - . become underscores."""
    return F.regexp_replace(col(c), r"[^a-zA-Z0-9_\-.]", "_")


def slug(c: Column | str, most: int = 60, default: str = "show") -> Column:
    """F31. Lower-case letters and digits with hyphens between, at most so many characters."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(F.nullif(col(c), F.lit("")), F.lit(default))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.left(kept, F.lit(most)), F.lit("")), F.lit(default))


def extension(name: Column | str, default: str = "") -> Column:
    """The extension of a file name with its point, in lower case; the default if it has none."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(basename(name), r"^.+(\.[^.]+)$", 1)), F.lit("")), F.lit(default))


def audio_key(prefix: str, name: Column | str, *parts: Column | str) -> Column:
    """W18. Object key of a recording: its artist, album and title, those that are there, and the file's extension."""
    return F.concat(F.lit(prefix), _known_parts(*parts), extension(name))


def artwork_key(prefix: str, name: Column | str, *parts: Column | str) -> Column:
    """W18. Object key of a cover: its artist, album and catalogue number, and the file's extension."""
    return F.concat(F.lit(f"{prefix}artwork/"), _known_parts(*parts), extension(name, ".jpg"))


def _known_parts(*parts: Column | str) -> Column:
    return F.array_join(F.filter(F.array(*[path_part(p) for p in parts]), lambda p: (p != "") & (p != "Unknown")), "_")


def episode_audio_key(show: Column | str, number: Column, title: Column | str) -> Column:
    """W18. Object key of an episode: its show, its number with three digits or 'ep', and its title."""
    return F.concat(F.lit("podcasts/audio/"), slug(show), F.lit("/"), F.coalesce(_three(number), F.lit("ep")), F.lit("-"), slug(title), F.lit(".mp3"))


def episode_art_key(show: Column | str, number: Column, stamp: Column, name: Column | str) -> Column:
    """W18. Object key of an episode's cover; without a number a stamp keeps it apart from the others."""
    return F.concat(F.lit("artwork/podcast-"), slug(show), F.lit("-ep"), F.coalesce(_three(number), stamp.cast("string")), extension(name, ".jpg"))


def playlist_art_key(playlist: Column | str, name: Column | str) -> Column:
    """W18. Object key of a playlist's cover, the same for each cover of it."""
    return F.concat(F.lit("artwork/playlist-"), slug(playlist), extension(name, ".jpg"))


def _three(number: Column) -> Column:
    n = F.nullif(number, F.lit(0)).cast("string")
    return F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)


def hashtag(c: Column | str) -> Column:
    """F43. # and the words of a name with capital initials; null if it has none."""
    words = F.filter(F.split(F.regexp_replace(col(c), "['’]", ""), "[^a-zA-Z0-9]+"), lambda x: x != "")
    tag = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))), "")
    return F.when(tag != "", F.concat(F.lit("#"), tag))


def hashtags(first: str, *names: Column | str, most: int = 3) -> Column:
    """F43. A fixed tag and those of names, at most so many, with spaces."""
    return F.array_join(F.slice(F.array_compact(F.array(F.lit(first), *[hashtag(n) for n in names])), 1, most), " ")


def xml_escape(c: Column | str, apostrophes: bool = True) -> Column:
    """F34. Text for XML; empty for null. The ampersand goes first."""
    out = F.coalesce(col(c).cast("string"), F.lit(""))
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), *([("'", "&apos;")] if apostrophes else [])):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out
