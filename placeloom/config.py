"""All constants of the engine in one place."""

from __future__ import annotations

from dataclasses import dataclass

# Keyword, language; the posts of a language are only searched when it has keywords.
TAGS = """
flood, en
floods, en
flooding, en
flooded, en
inundation, en
inundations, en
inundated, en
banjir, id
baha, tl
bumabaha, tl
pagbaha, tl
inonder, fr
inondation, fr
flut, de
hochwasser, de
Überflutung, de
inondazione, it
inondacioni, it
alluvione, it
overstroming, nl
powódź, pl
powodzie, pl
poplava, sr
poplave, sr
поплава, sr
поплаве, sr
inundação, pt
inundacão, pt
inundaçao, pt
inundacao, pt
alagar, pt
inundações, pt
inundación, es
inundacion, es
inundar, es
desbordar, es
anegar, es
inundaciones, es
su taşkın, tr
su baskını, tr
sel bastı, tr
sel suyu, tr
sel suyu bastı, tr
sel suyu taştı, tr
sel yüzünden, tr
taşkın oldu, tr
sel suyunun, tr
"""

# Feature codes by use.
TOWN_CODES = ("PPL", "PPLA", "PPLA2", "PPLA3", "PPLA4", "PPLC", "PPLG", "PPLR", "PPLS", "STLMT")
ADM_CODES = ("ADM1", "ADM1H", "ADM2", "ADM2H")
KEPT_CODES = (
    "PPL", "PPLA", "PPLA2", "PPLA3", "PPLA4", "PPLC", "PPLCH", "PPLF", "PPLG", "PPLH", "PPLL", "PPLQ", "PPLR", "PPLS", "PPLW", "PPLX", "STLMT",
    "PCLI", "ADM1", "ADM2", "ADM1H", "ADM2H", "CONT",
)


@dataclass(frozen=True)
class Settings:
    """Thresholds, weights and windows. Distances in metres, times in hours."""

    max_ngram: int = 3
    min_gram_length: int = 4
    near_m: float = 200_000.0
    threshold: float = 0.2
    min_population_capitalized: int = 1
    min_population_other: int = 5_000
    common_words: int = 1_000
    common_words_cap: int = 10_000
    common_exclude_population: int = 100_000
    home_min_population: int = 10_000
    family_min_population: int = 5_000
    family_min_length: int = 7
    window_h: int = 24
    slide_h: int = 6
    near_duplicate_distance: float = 0.20
    score_coordinates: float = 2
    score_home: float = 1
    score_bbox: float = 2
    score_family: float = 3
    score_offset: float = 0.5
    #: "intended" scores family over posts without near duplicates; "as_written" lets the bbox score stand in.
    family_mode: str = "intended"
    #: Languages that write names with capitals.
    capitalizing: tuple[str, ...] = ("en", "es", "fr", "de", "it", "nl", "pt", "id", "tr", "sr", "tl", "pl")


DEFAULT = Settings()


def tag_rows(text: str = TAGS) -> list[tuple[str, str]]:
    """(tag, language) of a tags text; spaces in tags are removed, so tags of several words match joined ones."""
    return [(tag.replace(" ", ""), lang.strip()) for tag, lang in (line.rsplit(",", 1) for line in text.splitlines() if "," in line)]
