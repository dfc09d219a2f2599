"""The language dimension: display names to codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, col, trimmed

# Language names in lower case and the codes that releases carry.
CODES = {
    "afrikaans": "af",
    "english": "en",
    "zulu": "zu",
    "isizulu": "zu",
    "xhosa": "xh",
    "isixhosa": "xh",
    "northern sotho": "nso",
    "northern sotho (pedi)": "nso",
    "sepedi": "nso",
    "pedi": "nso",
    "sesotho sa leboa": "nso",
    "sotho": "st",
    "southern sotho": "st",
    "sesotho": "st",
    "tswana": "tn",
    "setswana": "tn",
    "tsonga": "ts",
    "tsonga (shangaan)": "ts",
    "xitsonga": "ts",
    "shangaan": "ts",
    "swazi": "ss",
    "swati": "ss",
    "siswati": "ss",
    "venda": "ve",
    "tshivenda": "ve",
    "northern ndebele": "nd",
    "ndebele": "nr",
    "south ndebele": "nr",
    "isindebele": "nr",
    "french": "fr",
    "italian": "it",
    "portuguese": "pt",
    "portugese": "pt",
    "shona": "sn",
    "chishona": "sn",
    "swahili": "sw",
    "kiswahili": "sw",
    "nyanja": "ny",
    "chichewa": "ny",
    "herero": "hz",
    "greek": "el",
    "instrumental": "zxx",
    "no linguistic content": "zxx",
}


def language_code(c: Column | str) -> Column:
    """F37, J14. Code of a language name; names of up to three characters are codes already; unknown names have none."""
    known = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    name = clean(c)
    return F.when(F.length(name) <= 3, name).otherwise(F.try_element_at(known, F.lower(trimmed(col(c)))))
