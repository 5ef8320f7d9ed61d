"""Short reports of threats in the air: weapon, number, region, places and the tally of a night, from text.

A post is cut into tokens once. Every token has a role, written as one letter, so a post is a string of roles as long as its
list of tokens, and a phrase is a short pattern of roles: a place in the one is a token of the other. Numbers and names are
then read off the tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.sources.feeds import geocode

# Words that tell a weapon, the most specific first.
WEAPONS = [
    ("ballistic", ("балісти",)), ("cruise_missile", ("крилат", "мгкр", "калібр", "кр ")), ("missile", ("ракет", "🚀")), ("glide_bomb", ("каб", "💣")),
    ("jet_uav", ("реактив", "🏍")), ("uav", ("бпла", "шахед", "🛵", "🅿")),
]
# Region stems in any case ending and their codes.
REGIONS = {
    "вінниччин": "UA-05", "волин": "UA-07", "луганщин": "UA-09", "дніпропетровщин": "UA-12", "дніпровщин": "UA-12", "донеччин": "UA-14", "житомирщин": "UA-18",
    "закарпатт": "UA-21", "запоріжж": "UA-23", "прикарпатт": "UA-26", "івано-франківщин": "UA-26", "київщин": "UA-32", "кіровоградщин": "UA-35", "крим": "UA-43",
    "львівщин": "UA-46", "миколаївщин": "UA-48", "одещин": "UA-51", "полтавщин": "UA-53", "рівненщин": "UA-56", "сумщин": "UA-59", "тернопільщин": "UA-61",
    "харківщин": "UA-63", "херсонщин": "UA-65", "хмельниччин": "UA-68", "черкащин": "UA-71", "чернігівщин": "UA-74", "буковин": "UA-77", "чернівеччин": "UA-77",
}
# Words before the place a threat heads for, and before one it passes.
TOWARD = ("курсом", "курс", "вектор", "напрямку", "напрямок")
ONTO = "на"
PASSING = ("повз", "біля", "районі", "над", "від")
# What stands short for village, town and settlement before a name.
PREFIXES = ("н.п.", "н. п.", "м.", "смт.", "смт", "с.")
# Endings of adjectives, which name a region and no town, and names that are never a target.
ADJECTIVES = ("ського", "ської", "ський", "ська", "цького", "цької", "ному", "ної")
NO_TARGETS = ("київ", "київщині", "київщина")
# Cities that head a report, and the code of the one that is a region.
HEADERS = ("київ", "харків", "одеса", "дніпро", "запоріжжя", "суми", "миколаїв", "херсон", "чернігів")
CAPITAL_REGION = ("київ", "UA-30")
# Beginnings of the words of a night's tally.
DOWNED, ATTACKED, WITH, ATTACKERS, HIT, FALL, SHOT, PLACES = "збито/подавлено", "атакував", "ударними", ("бпла", "ракет"), "влучання", "падіння", "збитих", "локац"
# Beginnings of words for what flies, between a count and a bare place.
FLYING = ("реактив", "мгкр", "бпла", "шахед")
# The word before the launch areas, words between them, and words that are no part of their names.
AREAS, AND, NOISE = ("напрямку", "напрямків"), ("та", "і"), ("тот", "ар", "рф")
# Signs of multiplication after a count.
TIMES = ("х", "x")

#: People of a place that a bare name may mean, and of a launch area.
PEOPLE, LAUNCH_PEOPLE = 300, 1000
#: Roles: number, sign of times, toward, onto, passing, prefix, name, region, adjective, what flies, other word, full stop, break of a list, dash.
_NUMBER, _TIMES, _TOWARD, _ONTO, _PASSING, _PREFIX, _NAME, _REGION, _ADJECTIVE, _FLYING, _WORD, _STOP, _BREAK, _DASH = "1xtopfNRAwo.,-"
_PREFIX_MARK = "\u2020"


def tokens(post: Column) -> Column:
    """Numbers, words (with their hyphens, apostrophes and slashes), line feeds and single signs, in order."""
    marked = post
    for short in sorted(PREFIXES, key=len, reverse=True):
        end = r"(?=\s)" if short[-1] != "." else ""
        marked = F.regexp_replace(marked, r"(?U)(?<![\w'’ʼ-])" + short.replace(".", r"\.") + end, f" {_PREFIX_MARK} ")
    return F.regexp_extract_all(marked, F.lit(r"(?U)\d+|\p{L}[\p{L}'’ʼ]*(?:[-/]\p{L}[\p{L}'’ʼ]*)*|\n|[^\s\d\p{L}]"), F.lit(0))


def role(token: Column) -> Column:
    """The letter of a token's role."""
    low = F.lower(token)
    starts = lambda words: _either(F.startswith(low, F.lit(w)) for w in words)
    out = F.when(token.rlike(r"^\d"), _NUMBER).when(low.isin(*TIMES), _TIMES).when(token == _PREFIX_MARK, _PREFIX)
    out = out.when(low == ONTO, _ONTO).when(low.isin(*TOWARD), _TOWARD).when(low.isin(*PASSING), _PASSING)
    out = out.when(token.isin(".", "!", "?", "\n"), _STOP).when(token.isin(",", ";"), _BREAK).when(token.isin("–", "—", "-"), _DASH)
    out = out.when(starts(REGIONS), _REGION).when(_either(F.endswith(low, F.lit(e)) for e in ADJECTIVES), _ADJECTIVE)
    # Another alphabet than the reports' own names no place.
    out = out.when(starts(FLYING), _FLYING).when(token.rlike(r"^[\p{Lu}&&\p{IsCyrillic}]"), _NAME)
    return out.otherwise(_WORD)


def _either(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _every() -> Column:
    """The places of all tokens, from 1."""
    return F.when(F.size("tokens") > 0, F.sequence(F.lit(1), F.size("tokens"))).otherwise(F.array().cast("array<int>"))


def _at(pattern: str, whole: str = "") -> Column:
    """Places in roles where a pattern begins, in order, each with the length of what it matches before a name or number."""
    every = F.transform(_every(), lambda i: F.struct(i.alias("at"), F.length(F.regexp_extract(F.substring(F.col("roles"), i, F.lit(12)), f"^({pattern}){whole}", 1)).alias("n")))
    return F.filter(every, lambda p: p["n"] > 0)


def _names(pattern: str) -> Column:
    """Names of one or two words behind a pattern of roles, each once, in order: struct of at and name."""
    found = F.transform(_at(pattern, _NAME), lambda p: F.struct((p["at"] + p["n"]).alias("at"), F.when(F.substring(F.col("roles"), p["at"] + p["n"] + 1, F.lit(1)) == _NAME, 2).otherwise(1).alias("words")))
    return F.array_distinct(F.transform(found, lambda p: F.struct(p["at"].alias("at"), F.array_join(F.slice("tokens", p["at"], p["words"]), " ").alias("name"))))


def _low(i: Column) -> Column:
    return F.lower(F.try_element_at("tokens", i))


def _number_after(first: Column) -> Column:
    """The number at a token's place, if there is one."""
    return F.when(F.substring(F.col("roles"), first, F.lit(1)) == _NUMBER, F.try_element_at("tokens", first)).try_cast("int")


def _first_where(condition) -> Column:
    """The first token's place for which a condition of place and lower-cased token holds."""
    return F.try_element_at(F.filter(_every(), lambda i: condition(i, _low(i))), F.lit(1))


def _places_of(words: tuple[str, ...]) -> Column:
    """How many places a sentence names, behind words that begin so."""
    begun = lambda i: _all(F.startswith(_low(i + k), F.lit(w)) for k, w in enumerate(words))
    behind = lambda i: F.filter(F.sequence(i, F.size("tokens")), lambda j: (_low(j) == ONTO) & (F.substring(F.col("roles"), j + 1, F.lit(1)) == _NUMBER) & F.startswith(_low(j + 2), F.lit(PLACES)) & ~F.contains(F.substring(F.col("roles"), i, j - i), F.lit(_STOP)))
    found = F.flatten(F.transform(F.filter(_every(), lambda i: F.coalesce(begun(i), F.lit(False))), behind))
    return F.try_element_at("tokens", F.try_element_at(found, F.lit(1)) + 1).try_cast("int")


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _launch_areas() -> Column:
    """Names listed behind "from the directions of", up to the sentence's end; of a name with a dash what follows the last one counts."""
    begins = _first_where(lambda i, low: low.isin(*AREAS) & (F.try_element_at("tokens", i + 1) == ":"))
    stop = F.try_element_at(F.filter(F.sequence(begins + 1, F.size("tokens") + 1), lambda i: F.substring(F.concat(F.col("roles"), F.lit(_STOP)), i, F.lit(1)) == _STOP), F.lit(1))
    inside = F.slice("tokens", begins + 2, F.greatest(stop - begins - 2, F.lit(0)))
    noise = lambda x: F.lower(x).isin(*NOISE) | x.rlike(r"^[«»\"“”()]$") | (x == _PREFIX_MARK)
    parts = F.transform(inside, lambda x: F.when(x.isin(",", ";") | x.isin(*AND), ",").when(x.isin("–", "—", "-"), "–").when(~noise(x), x))
    named = F.transform(F.split(F.array_join(F.array_compact(parts), " "), ","), lambda x: F.trim(F.element_at(F.split(x, "–"), -1)))
    return F.coalesce(F.filter(named, lambda x: x != ""), F.array().cast("array<string>"))


def read(posts: DataFrame, key: str = "id", body: str = "text") -> DataFrame:
    """What a post says before any name is looked up: weapon, count, region, the numbers of a tally, and names by use in order.

    to and at hold names that may be targets and places passed, launch those of launch areas. A null text says nothing.
    """
    x = posts.select(key, F.coalesce(F.col(body), F.lit("")).alias("_body")).withColumn("tokens", tokens(F.col("_body")))
    x = x.withColumn("roles", F.array_join(F.transform("tokens", role), ""))
    codes = F.create_map(*(F.lit(v) for pair in REGIONS.items() for v in pair))
    region = F.try_element_at(F.filter("tokens", lambda t: role(t) == _REGION), F.lit(1))
    stem = F.try_element_at(F.filter(F.array(*(F.lit(r) for r in sorted(REGIONS, key=len, reverse=True))), lambda r: F.startswith(F.lower(region), r)), F.lit(1))
    heads = F.try_element_at(F.filter("tokens", lambda t: ~role(t).isin(_STOP, _BREAK, _DASH) & t.rlike(r"^\p{L}|^:")), F.lit(1))
    header = F.when(F.lower(heads).isin(*HEADERS) & (F.try_element_at("tokens", F.array_position("tokens", heads).cast("int") + 1) == ":"), heads)
    downed = _number_after(_first_where(lambda i, low: low == DOWNED) + 1)
    attacked_at = _first_where(lambda i, low: F.startswith(low, F.lit(ATTACKED)))
    skip = F.when(_low(attacked_at + 2) == WITH, 1).otherwise(0)
    attacked = F.when(_either(F.startswith(_low(attacked_at + 2 + skip), F.lit(w)) for w in ATTACKERS), _number_after(attacked_at + 1))
    count = F.try_element_at("tokens", F.try_element_at(_at(_NUMBER, _TIMES), F.lit(1))["at"]).try_cast("int")
    fit = lambda names: F.filter(F.transform(names, lambda p: p["name"]), lambda n: ~F.lower(n).isin(*NO_TARGETS))
    past, bare = fit(_names(f"{_PASSING}{_PREFIX}*")), fit(_names(f"{_NUMBER}{_TIMES}{_FLYING}?{_PREFIX}*"))
    to = fit(_names(f"[{_TOWARD}{_ONTO}]{_ONTO}*{_PREFIX}*"))
    return x.select(
        key, text.first_class(F.col("_body"), WEAPONS).alias("weapon"), count.alias("count"),
        F.when(downed.isNull(), F.coalesce(F.try_element_at(codes, stem), F.when(F.lower(header) == CAPITAL_REGION[0], CAPITAL_REGION[1]))).alias("region"),
        downed.alias("downed"), attacked.alias("attacked"), _places_of((HIT,)).alias("hit_locations"), _places_of((FALL, SHOT)).alias("debris_locations"),
        to.alias("to"), F.array_compact(F.concat(F.slice(past, 1, 1), F.array(F.when(region.isNull() & ~F.lower(header).isin(*NO_TARGETS), F.initcap(header))), F.slice(bare, 1, 1))).alias("at"),
        F.when(downed.isNotNull(), _launch_areas()).otherwise(F.array().cast("array<string>")).alias("launch"))


def parse(posts: DataFrame, places: DataFrame, key: str = "id", body: str = "text", people: int = PEOPLE, launch_people: int = LAUNCH_PEOPLE) -> DataFrame:
    """What each post says: weapon, count, region, target and place passed (geocoded), and the tally of a night with its launch areas.

    A post with a tally has no region and no target. Of the names that may be a target, the first that is no region, no
    adjective and none of those set apart, and that the gazetteer knows with enough people, is taken; the place is the one
    passed, else the heading city, else the bare name behind a count. Launch areas that the gazetteer knows are listed in order.
    """
    x = read(posts, key, body).withColumn("weapon", F.coalesce("weapon", F.when(F.col("count").isNotNull(), "unknown")))
    named = x.where("downed IS NULL")
    asked = named.select(key, F.posexplode("to").alias("pos", "query"), F.lit("to").alias("how")).unionByName(named.select(key, F.posexplode("at").alias("pos", "query"), F.lit("at").alias("how")))
    launch = x.where("downed IS NOT NULL").select(key, F.posexplode("launch").alias("pos", "query"), F.lit("launch").alias("how"))
    find = lambda names, least: geocode(names.select("query").distinct(), places.where(F.col("population") >= least)).select("query", "name")
    hit = asked.join(find(asked, people), "query").unionByName(launch.join(find(launch, launch_people), "query"))
    first = lambda how: F.min_by("name", F.when(F.col("how") == how, F.col("pos")))
    listed = F.transform(F.sort_array(F.collect_list(F.when(F.col("how") == "launch", F.struct("pos", "name")))), lambda p: p["name"])
    hit = hit.groupBy(key).agg(first("to").alias("to_place"), first("at").alias("at_place"), listed.alias("launch_areas"))
    x = x.drop("to", "at", "launch").join(hit, key, "left").withColumn("launch_areas", F.coalesce("launch_areas", F.array().cast("array<string>")))
    where = F.coalesce(F.concat(F.lit(" near "), F.col("at_place")), F.concat(F.lit(" over "), F.col("region")), F.lit(""))
    said = F.concat(F.coalesce(F.concat(F.col("count").cast("string"), F.lit("× ")), F.lit("")), F.coalesce("weapon", F.lit("report")), where, F.coalesce(F.concat(F.lit(", heading for "), F.col("to_place")), F.lit("")))
    tally = F.concat(F.lit("overnight attack: "), F.coalesce(F.col("attacked").cast("string"), F.lit("?")), F.lit(" launched, "), F.col("downed").cast("string"), F.lit(" downed"))
    return x.withColumn("summary", F.when(F.col("downed").isNotNull(), tally).otherwise(said))
