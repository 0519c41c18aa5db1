"""SQL of the engine's steps for a second engine, as named parts that build on each other."""

from __future__ import annotations

from placeloom.config import ADM_CODES, DEFAULT, KEPT_CODES, TOWN_CODES, tag_rows

R = "6371009.0"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def distance(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"2 * {R} * asin(sqrt(least(1, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


def kind(code: str = "feature_code", adm1: str = "is_adm1") -> str:
    return f"CASE WHEN {code} IN ({quoted(TOWN_CODES)}) THEN 'town' WHEN {code} IN ({quoted(ADM_CODES)}) OR {adm1} THEN 'adm1' WHEN {code} = 'PCLI' THEN 'country' WHEN {code} = 'CONT' THEN 'continent' END"


def size(kind: str) -> str:
    return f"CASE {kind} WHEN 'continent' THEN 0 WHEN 'country' THEN 1 WHEN 'adm1' THEN 2 ELSE 3 END"


def family(a: str, b: str, a_name: str, b_name: str, siblings: bool = True, by_length: bool = True, least: int = 1, continents: str = "NULL") -> str:
    """a and b are prefixes such as 'x.' or 'home_'."""
    near = f"{distance(a + 'longitude', a + 'latitude', b + 'longitude', b + 'latitude')} < {DEFAULT.near_m}"
    same = "false"
    if siblings:
        same = f"CASE WHEN {a}type = 'town' THEN {a}population >= {least} AND {b}population >= {least} AND {near} WHEN {a}type = 'adm1' THEN {a}country_geonameid IS NOT DISTINCT FROM {b}country_geonameid ELSE true END"
    first = f"({size(a + 'type')}) <= ({size(b + 'type')})"
    big = lambda f: f"(CASE WHEN {first} THEN {a}{f} ELSE {b}{f} END)"
    small = lambda f: f"(CASE WHEN {first} THEN {b}{f} ELSE {a}{f} END)"
    inner = f"{big('geonameid')} IS NOT DISTINCT FROM {small('adm1_geonameid')}"
    if by_length:
        inner = f"length({a_name}) >= {DEFAULT.family_min_length} AND length({b_name}) >= {DEFAULT.family_min_length} AND {inner}"
    else:
        inner = f"({inner} OR {big('adm1_geonameid')} IS NOT DISTINCT FROM {small('adm1_geonameid')})"
    return f"coalesce(CASE WHEN {a}type = {b}type THEN {same} WHEN {big('type')} = 'continent' THEN {small('type')} = 'country' AND coalesce(list_contains({continents}, {big('geonameid')}), false) WHEN {big('type')} = 'country' THEN {big('country_geonameid')} IS NOT DISTINCT FROM {small('country_geonameid')} ELSE {inner} END, false)"


WORD = r"[\p{L}\p{M}\p{N}_]"
SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PUNCT = r"[!-/:-@\[-`{-~]"
TOKEN = r"[\p{L}\p{M}\p{N}_]+(?:[-''][\p{L}\p{M}\p{N}_]+)*|\.{2,}|[^\s\p{L}\p{M}\p{N}_]"


def clean(text: str = "text") -> str:
    x = f"regexp_replace(regexp_replace({text}, '(^|[^\\p{{L}}\\p{{N}}_])RT([^\\p{{L}}\\p{{N}}_]|$)', '\\1\\2', 'g'), '@[\\p{{L}}\\p{{N}}_]+', '', 'g')"
    x = f"regexp_replace(replace({x}, '#', ''), 'https?://[^ ^\\r\\n]*', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    x = f"regexp_replace(regexp_replace({x}, '([^\\n])([A-Z]+[a-z]+(?:-[A-Z+a-z]+)*)', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    return f"trim(regexp_replace(replace(replace({x}, '_', ' '), '''', ' '), '{SPACE}+', ' ', 'g'))"


def title(x: str) -> str:
    return f"(regexp_matches({x}, '\\p{{Lu}}') AND NOT regexp_matches({x}, '(^|[^\\p{{L}}])\\p{{Ll}}') AND NOT regexp_matches({x}, '\\p{{L}}\\p{{Lu}}'))"


def upper_first(x: str) -> str:
    return f"regexp_matches({x}, '^\\p{{Lu}}')"


def all_upper(x: str) -> str:
    return f"(NOT regexp_matches({x}, '(^| )[^\\p{{Lu}}]'))"


def gate(languages: str, lang: str) -> str:
    return f"(list_contains({languages}, 'general') OR coalesce(list_contains({languages}, {lang}), false))"


_GRAMS = " || ".join(f"list_transform(range(1, len(t) - {k} + 2), lambda i: array_to_string(t[i:i + {k - 1}], ' '))" for k in range(1, DEFAULT.max_ngram + 1))
_INSIDE = "(y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1"

#: name -> (parts it needs, body)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "base": ((), "SELECT DISTINCT post_id, posted_at, text, lang, retweet, author.id AS user_id, author.location AS home, author.utc_offset AS utc_offset, coordinates.lon AS lon, coordinates.lat AS lat, bbox FROM posts"),
    "tag": ((), "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{lang}')" for t, lang in tag_rows()) + ") AS v(tag, lang)"),
    "tags_of": (("tag",), "SELECT lang, list(DISTINCT tag ORDER BY tag DESC) AS tags FROM tag GROUP BY lang"),
    "cleaned": (("base",), f"SELECT *, {clean()} AS clean FROM base"),
    "token": (("cleaned",), f"SELECT post_id, lang, clean, list_filter(regexp_extract_all(clean, '{TOKEN}'), lambda t: NOT regexp_matches(t, '^{PUNCT}$')) AS t FROM cleaned"),
    "gram_list": (("token",), f"SELECT post_id, lang, clean, list_filter(list_distinct({_GRAMS}), lambda g: NOT regexp_matches(g, '{PUNCT}') AND NOT regexp_matches(g, '\\p{{N}}')) AS grams FROM token"),
    "firsts": (("cleaned",), r"SELECT post_id, list_distinct(list_transform(regexp_extract_all(clean, '(?:^|(?:[.!?:][ \t\r\n\f]))([\p{L}\p{M}\p{N}_]+)', 1), lambda w: lower(w))) AS first_words FROM cleaned"),
    "raw_gram": (("gram_list", "tags_of"), "SELECT post_id, lang, tags, unnest(grams) AS g FROM gram_list JOIN tags_of USING (lang)"),
    "tagged": (("raw_gram",), "SELECT *, list_filter(tags, lambda t: contains(lower(g), t))[1] AS tag FROM raw_gram"),
    "gram": (("tagged",), "SELECT post_id, lang, tags, gram, cut FROM (SELECT post_id, lang, tags, tag IS NOT NULL AS cut, coalesce(replace(trim(substr(g, 1, instr(lower(g), tag) - 1) || substr(g, instr(lower(g), tag) + length(tag))), '  ', ' '), g) AS gram FROM tagged) WHERE gram <> ''"),
    "kept": ((), f"SELECT g.*, a.geonameid IS NOT NULL AS is_adm1 FROM geonames g LEFT JOIN (SELECT DISTINCT geonameid FROM adm1) a USING (geonameid) WHERE feature_code IN ({quoted(KEPT_CODES)}) OR a.geonameid IS NOT NULL"),
    "alternate": (("kept",), "SELECT * FROM alternate_names WHERE (isolanguage IS NULL OR isolanguage NOT IN ('link', 'post')) AND geonameid IN (SELECT geonameid FROM kept)"),
    "translation": (("alternate",), "SELECT geonameid, count(*) AS translations FROM alternate GROUP BY 1"),
    "named": (("kept", "alternate"), "SELECT name, geonameid, coalesce(list(DISTINCT language ORDER BY language) FILTER (WHERE language IS NOT NULL), []) AS languages, coalesce(list(DISTINCT abbreviation ORDER BY abbreviation) FILTER (WHERE abbreviation IS NOT NULL), []) AS abbreviations FROM (SELECT name, geonameid, 'general' AS language, NULL AS abbreviation FROM kept UNION ALL SELECT alternate_name, geonameid, isolanguage, CASE WHEN isolanguage = 'abbr' THEN full_name END FROM alternate) GROUP BY 1, 2"),
    "gaz": (("named", "kept", "translation"), f"SELECT * FROM (SELECT n.*, feature_code, {kind()} AS type, coalesce(population, 0) AS population, longitude, latitude, country_geonameid, adm1_geonameid, time_zone, coalesce(translations, 0) AS translations FROM named n JOIN kept USING (geonameid) LEFT JOIN translation USING (geonameid)) WHERE type IS NOT NULL"),
    "admin_place": ((), f"SELECT * FROM (SELECT g.geonameid, name, {kind(adm1='a.geonameid IS NOT NULL')} AS type, coalesce(population, 0) AS population, country_geonameid, adm1_geonameid, longitude, latitude FROM geonames g LEFT JOIN (SELECT DISTINCT geonameid FROM adm1) a USING (geonameid)) WHERE type IN ('adm1', 'country')"),
    "admin_alternate": (("admin_place",), "SELECT * FROM alternate_names WHERE (isolanguage IS NULL OR isolanguage NOT IN ('link', 'post')) AND geonameid IN (SELECT geonameid FROM admin_place)"),
    "admin": (("admin_place", "admin_alternate"), "SELECT n.name, p.* EXCLUDE (name), coalesce(abbreviations, []) AS abbreviations FROM (SELECT name, geonameid FROM admin_place UNION SELECT alternate_name, geonameid FROM admin_alternate) n JOIN admin_place p USING (geonameid) LEFT JOIN (SELECT geonameid, list(DISTINCT full_name ORDER BY full_name) AS abbreviations FROM admin_alternate WHERE isolanguage = 'abbr' GROUP BY 1) USING (geonameid)"),
    "country_name": (("admin",), "SELECT DISTINCT name FROM admin WHERE type = 'country'"),
    "common": ((), f"SELECT lang, word FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n, word) AS r FROM most_common_words WHERE n <= {DEFAULT.common_words_cap}) WHERE r <= {DEFAULT.common_words} AND word NOT IN (SELECT name FROM geonames WHERE population > {DEFAULT.common_exclude_population})"),
    "met": (("gram", "gaz", "country_name", "common"), f"SELECT *, lower(gram) AS toponym FROM gram WHERE lower(gram) IN (SELECT name FROM gaz) AND (lower(gram) IN (SELECT name FROM country_name) OR (length(gram) >= {DEFAULT.min_gram_length} AND (lang, lower(gram)) NOT IN (SELECT (lang, word) FROM common)))"),
    "named_once": (("met",), f"SELECT post_id, lang, toponym, any_value(tags) AS tags, coalesce(min(gram) FILTER (WHERE {title('gram')}), min(gram)) AS original, bool_or(cut AND gram = toponym) AS cut FROM met GROUP BY 1, 2, 3"),
    "beaten": (("named_once",), f"SELECT DISTINCT post_id, CASE WHEN {upper_first('i.original')} AND NOT {all_upper('o.original')} THEN o.toponym ELSE i.toponym END AS toponym FROM named_once i JOIN named_once o USING (post_id) WHERE i.toponym <> o.toponym AND contains(' ' || o.toponym || ' ', ' ' || i.toponym || ' ')"),
    "name": (("named_once", "beaten", "firsts"), "SELECT n.post_id, lang, n.toponym, original, cut, list_contains(first_words, n.toponym) AS first_word FROM named_once n JOIN firsts USING (post_id) ANTI JOIN beaten b ON b.post_id = n.post_id AND b.toponym = n.toponym WHERE NOT list_contains(tags, n.toponym)"),
    "lost": (("gaz",), f"SELECT toponym, geonameid, max(rival) AS rival_population FROM (SELECT a.name AS toponym, CASE WHEN w THEN b_id ELSE a_id END AS geonameid, CASE WHEN w THEN a_pop ELSE b_pop END AS rival FROM (SELECT a.name, a.geonameid AS a_id, b.geonameid AS b_id, a.population AS a_pop, b.population AS b_pop, a.translations > b.translations OR (a.translations = b.translations AND ({size('a.type')}) <= ({size('b.type')})) AS w FROM gaz a JOIN gaz b ON a.name = b.name AND a.geonameid < b.geonameid WHERE {family('a.', 'b.', 'a.name', 'a.name', siblings=False, by_length=False)}) a) GROUP BY 1, 2"),
    "candidate": (("name", "gaz", "lost"), f"SELECT c.* EXCLUDE (least) FROM (SELECT n.*, g.* EXCLUDE (name), CASE WHEN lang IN ({quoted(DEFAULT.capitalizing)}) AND NOT first_word AND {title('original')} THEN {DEFAULT.min_population_capitalized} ELSE {DEFAULT.min_population_other} END AS least FROM name n JOIN gaz g ON g.name = n.toponym) c LEFT JOIN lost l USING (toponym, geonameid) WHERE population >= least AND (rival_population IS NULL OR rival_population < least)"),
    "point": (("base",), "SELECT post_id, lon AS x, lat AS y, true AS exact FROM base WHERE lon IS NOT NULL UNION ALL SELECT post_id, (bbox[1] + bbox[3]) / 2, (bbox[2] + bbox[4]) / 2, false FROM base WHERE lon IS NULL AND bbox IS NOT NULL"),
    "country_edge": ((), "SELECT geonameid, r[i].lon AS x1, r[i].lat AS y1, r[1 + i % len(r)].lon AS x2, r[1 + i % len(r)].lat AS y2 FROM (SELECT geonameid, r, unnest(range(1, len(r) + 1)) AS i FROM (SELECT geonameid, unnest(rings) AS r FROM countries))"),
    "area": (("point", "country_edge"), f"SELECT post_id, list(geonameid ORDER BY geonameid) AS areas FROM (SELECT post_id, geonameid FROM point JOIN country_edge ON true GROUP BY 1, 2, x, y HAVING count(*) FILTER (WHERE {_INSIDE}) % 2 = 1) GROUP BY 1"),
    "zone_offset": ((), "SELECT DISTINCT time_zone AS zone, -3600 * coalesce(try_cast(nullif(regexp_extract(time_zone, 'GMT([+-][0-9]+)$', 1), '') AS INT), 0) AS offset_s FROM geonames WHERE time_zone IS NOT NULL"),
    "post_zone": (("base", "zone_offset"), "SELECT post_id, list(zone ORDER BY zone) AS zones FROM base JOIN zone_offset ON offset_s = utc_offset GROUP BY 1"),
    "area_zone": ((), "SELECT country_geonameid AS geonameid, list(DISTINCT time_zone ORDER BY time_zone) AS area_zones FROM geonames WHERE time_zone IS NOT NULL AND country_geonameid IS NOT NULL GROUP BY 1"),
    "home_form": (("base",), "SELECT home, part, CASE WHEN n = 3 THEN trim(c[1] || c[2]) ELSE t END AS t, CASE WHEN n = 3 THEN 1 ELSE n END AS n FROM (SELECT home, part, t, string_split(t, ',') AS c, len(string_split(t, ',')) AS n FROM (SELECT home, part, replace(trim(p[part]), '.', '') AS t FROM (SELECT home, p, unnest(range(1, len(p) + 1)) AS part FROM (SELECT home, flatten(list_transform(flatten(list_transform(string_split(home, '/'), lambda x: string_split(x, ' and '))), lambda x: string_split(x, '&'))) AS p FROM (SELECT DISTINCT home FROM base WHERE home IS NOT NULL))))) WHERE n <= 3"),
    "home_tail": (("home_form",), "SELECT home, part, k, array_to_string(l[len(l) - k + 1:], ' ') AS name, array_to_string(o[greatest(len(o) - k, 0) + 1:], ' ') AS original, trim(substr(lower(t), 1, length(t) - length(array_to_string(l[len(l) - k + 1:], ' ')))) AS child FROM (SELECT home, part, t, string_split(lower(t), ' ') AS l, string_split(t, ' ') AS o, unnest(range(1, len(string_split(t, ' ')) + 1)) AS k FROM home_form WHERE n = 1) UNION ALL SELECT home, part, 1, trim(string_split(lower(t), ',')[2]), trim(string_split(t, ',')[2]), trim(string_split(lower(t), ',')[1]) FROM home_form WHERE n = 2"),
    "home_parent": (("home_tail", "admin"), "SELECT * FROM (SELECT *, min(k) OVER (PARTITION BY home, part) AS least_k FROM home_tail JOIN admin USING (name) WHERE len(abbreviations) = 0 OR list_contains(abbreviations, original)) WHERE k = least_k"),
    "home_kid": (("home_parent", "gaz"), f"SELECT p.home, p.part, p.geonameid AS parent, p.child AS toponym, max(g.population) AS top, min_by({{'geonameid': g.geonameid, 'type': g.type, 'population': g.population, 'country_geonameid': g.country_geonameid, 'adm1_geonameid': g.adm1_geonameid, 'longitude': g.longitude, 'latitude': g.latitude}}, (-g.population, g.geonameid)) FILTER (WHERE NOT list_contains(g.languages, 'abbr') OR (list_contains(g.abbreviations, p.original) AND {family('g.', 'p.', 'p.child', 'p.name', siblings=False)})) AS best FROM home_parent p JOIN gaz g ON g.name = p.child WHERE p.child <> '' GROUP BY ALL"),
    "home_town": (("home_form", "home_parent", "gaz"), f"SELECT home, toponym, best FROM (SELECT home, part, child AS toponym, max(population) AS top, min_by({{'geonameid': geonameid, 'type': type, 'population': population, 'country_geonameid': country_geonameid, 'adm1_geonameid': adm1_geonameid, 'longitude': longitude, 'latitude': latitude}}, (-population, geonameid)) FILTER (WHERE NOT list_contains(languages, 'abbr') OR list_contains(abbreviations, original)) AS best FROM (SELECT home, part, CASE WHEN n = 1 THEN lower(t) ELSE trim(string_split(lower(t), ',')[2]) END AS child, CASE WHEN n = 1 THEN t ELSE trim(string_split(t, ',')[2]) END AS original FROM home_form WHERE (home, part) NOT IN (SELECT (home, part) FROM home_parent)) f JOIN gaz ON gaz.name = child GROUP BY ALL) WHERE top >= {DEFAULT.home_min_population} AND best IS NOT NULL"),
    "home_place": (("home_kid", "home_town", "home_parent"), "SELECT DISTINCT home, toponym, best.* FROM (SELECT home, toponym, best FROM home_kid WHERE top > 0 AND best IS NOT NULL UNION ALL SELECT home, toponym, best FROM home_town) UNION SELECT home, name, geonameid, type, population, country_geonameid, adm1_geonameid, longitude, latitude FROM home_parent p WHERE (home, part, geonameid) NOT IN (SELECT (home, part, parent) FROM home_kid WHERE top > 0 AND best IS NOT NULL)"),
    "main_home": (("home_place",), "SELECT home, toponym AS home_toponym, geonameid AS home_geonameid, type AS home_type, population AS home_population, country_geonameid AS home_country_geonameid, adm1_geonameid AS home_adm1_geonameid, longitude AS home_longitude, latitude AS home_latitude FROM (SELECT *, row_number() OVER (PARTITION BY home ORDER BY population DESC, geonameid, toponym) AS r FROM home_place) WHERE r = 1"),
    "here": (("candidate", "base", "point", "area", "post_zone", "area_zone", "main_home"), "SELECT c.*, user_id, posted_at, exact, x, y, coalesce(areas, []) AS areas, zones, area_zones, k.continents, h.* EXCLUDE (home) FROM candidate c JOIN base USING (post_id) LEFT JOIN point USING (post_id) LEFT JOIN area USING (post_id) LEFT JOIN post_zone USING (post_id) LEFT JOIN area_zone USING (geonameid) LEFT JOIN main_home h ON h.home = base.home LEFT JOIN countries k ON k.geonameid = c.country_geonameid"),
    "at_point": (("here",), f"SELECT *, coalesce(CASE WHEN type = 'town' THEN {distance('x', 'y', 'longitude', 'latitude')} < {DEFAULT.near_m} WHEN type = 'continent' THEN list_contains(areas, geonameid) ELSE list_contains(areas, country_geonameid) END, false) AS supported FROM here"),
    "kin": (("here",), f"SELECT DISTINCT a.post_id, a.toponym, a.geonameid FROM here a JOIN here b ON a.post_id = b.post_id AND a.toponym <> b.toponym WHERE {family('a.', 'b.', 'a.toponym', 'b.toponym', siblings=False, least=DEFAULT.family_min_population, continents='a.continents')}"),
    "scored": (("at_point", "kin"), f"SELECT s.post_id, user_id, posted_at, lang, s.toponym, original, cut, s.geonameid, type, population, country_geonameid, adm1_geonameid, languages, abbreviations, CASE WHEN exact AND supported THEN {DEFAULT.score_coordinates} ELSE 0 END::DOUBLE AS s_coordinates, CASE WHEN home_geonameid IS NOT NULL AND {family('s.', 's.home_', 's.toponym', 's.home_toponym')} AND (home_type <> 'country' OR type = 'country' OR coalesce(population / nullif(home_population, 0), 0) > 0) THEN {DEFAULT.score_home} ELSE 0 END::DOUBLE AS s_home, CASE WHEN NOT exact AND supported THEN {DEFAULT.score_bbox} ELSE 0 END::DOUBLE AS s_bbox, CASE WHEN kin.post_id IS NOT NULL THEN {DEFAULT.score_family} ELSE 0 END::DOUBLE AS s_family, CASE WHEN coalesce(CASE WHEN type IN ('country', 'continent') THEN list_has_any(zones, area_zones) ELSE list_contains(zones, time_zone) END, false) THEN {DEFAULT.score_offset} ELSE 0 END::DOUBLE AS s_offset FROM at_point s LEFT JOIN kin USING (post_id, toponym, geonameid)"),
    "stepped": (("scored",), f"SELECT *, unnest(range(greatest(1, ceil(epoch(posted_at - TIMESTAMP '2016-01-04') / {DEFAULT.slide_h * 3600})::BIGINT), least(112, floor((epoch(posted_at - TIMESTAMP '2016-01-04') + {DEFAULT.window_h * 3600}) / {DEFAULT.slide_h * 3600})::BIGINT) + 1)) AS step FROM scored"),
    "user_row": (("stepped",), "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY step, toponym, geonameid, user_id ORDER BY posted_at DESC, post_id) AS r FROM stepped) WHERE r = 1"),
    "pooled": (("user_row", "stepped"), "SELECT p.*, CASE WHEN any_kin THEN t_bbox ELSE 0 END AS t_family, CASE WHEN any_kin THEN t_bbox / users ELSE 0 END AS a_family FROM (SELECT step, toponym, geonameid, count(*) AS users, any_value(type) AS type, any_value(population) AS population, any_value(country_geonameid) AS country_geonameid, any_value(adm1_geonameid) AS adm1_geonameid, any_value(languages) AS languages, any_value(abbreviations) AS abbreviations, " + ", ".join(f"floor(sum(CASE WHEN {gate('languages', 'lang')} THEN s_{x} ELSE 0 END)) AS t_{x}" for x in ("coordinates", "home", "bbox", "offset")) + " FROM user_row GROUP BY 1, 2, 3) p JOIN (SELECT step, toponym, geonameid, sum(s_family) > 0 AS any_kin FROM stepped GROUP BY 1, 2, 3) USING (step, toponym, geonameid)"),
    "averaged": (("pooled",), "SELECT *, round(t_coordinates / users + t_home / users + t_bbox / users + a_family + t_offset / users, 3) AS avg_score FROM pooled"),
    "able": (("averaged",), f"SELECT *, type IN ('country', 'continent') AS wide, bool_or(type IN ('country', 'continent')) OVER (PARTITION BY step, toponym) AS any_wide, row_number() OVER w AS r, first_value(type) OVER w AS top_type, first_value(country_geonameid) OVER w AS top_country FROM averaged WHERE avg_score >= {DEFAULT.threshold} OR type IN ('country', 'continent') WINDOW w AS (PARTITION BY step, toponym ORDER BY avg_score DESC, population DESC, geonameid)"),
    "winner": (("able",), "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY step, toponym ORDER BY CASE WHEN any_wide THEN CASE WHEN wide THEN -population END WHEN type = 'adm1' AND top_type <> 'adm1' AND country_geonameid IS NOT DISTINCT FROM top_country THEN r - 1000000 ELSE r END NULLS LAST, geonameid) AS place FROM able) WHERE place = 1"),
    "placed": (("stepped", "winner"), f"SELECT step, post_id, toponym, geonameid, type, population, country_geonameid, adm1_geonameid, avg_score FROM (SELECT s.*, avg_score, {upper_first('original')} AS up, bool_or({upper_first('original')}) OVER (PARTITION BY step, post_id) AS any_up FROM stepped s JOIN (SELECT step, toponym, geonameid, avg_score FROM winner) USING (step, toponym, geonameid) WHERE {gate('languages', 'lang')} OR (list_contains(languages, 'abbr') AND list_contains(abbreviations, original))) WHERE up OR NOT any_up OR cut"),
    "best": (("placed",), "SELECT post_id, toponym, step, geonameid, type, population, country_geonameid, adm1_geonameid, avg_score FROM (SELECT *, row_number() OVER (PARTITION BY post_id, toponym ORDER BY avg_score DESC, step) AS r FROM placed) WHERE r = 1"),
}


def with_parts(final: str, *needs: str) -> str:
    """`final` after the parts it needs, each once, in order."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in done:
            for need in PARTS[name][0]:
                add(need)
            done[name] = PARTS[name][1]

    for name in needs:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({b})" for n, b in done.items()) + "\n" + final
