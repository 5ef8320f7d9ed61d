"""Who operates a craft and what for: column expressions with the evidence of every rule that fired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators.joins import narrowest_range, small

# Mission and vehicle letters of military designations, status prefixes, look-alike maker codes.
MISSION = {
    "A": "strike", "B": "bomber", "C": "airlift", "E": "electronic", "F": "fighter", "H": "sar", "K": "tanker", "M": "multi_mission",
    "O": "isr", "P": "maritime_patrol", "R": "isr", "S": "maritime_patrol", "T": "trainer", "U": "utility", "V": "vip", "W": "weather",
}
VEHICLE = {"H": "helicopter", "Q": "uav", "V": "tiltrotor"}
STATUS = "GJNYZ"
NOT_MDS = (
    "AN", "AS", "ATR", "AW", "BAE", "BD", "BK", "BN", "CL", "CN", "CRJ", "DA", "DC", "DHC", "EC", "EMB", "ERJ", "HS", "IL", "KA", "MBB", "MD", "MI",
    "MIG", "PA", "PC", "PZL", "SA", "SC", "SF", "SR", "SU", "TB", "TU", "YAK",
)
SOVIET = ("TU", "AN", "IL", "YAK", "Y", "MI", "KA", "SU", "MIG", "BE")
# Operators by words of their name, navy name prefixes, ship types, uncrewed types.
BRANCHES = (
    ("Air Force", ("AIR FORCE", "USAF", "RAF", "LUFTWAFFE")), ("Navy", ("NAVY", "NAVAIR", "NAVAL")), ("Army", ("ARMY",)), ("Marine Corps", ("MARINE CORPS", "USMC")),
    ("Coast Guard", ("COAST GUARD",)), ("Special Operations", ("SPECIAL OPERATIONS",)), ("Border / Customs", ("CUSTOMS", "BORDER")),
    ("Government flight", ("GOVERNMENT", "ROYAL FLIGHT", "AMIRI", "ROYAL AIR WING")),
)
NAVY_PREFIXES = ("USS", "USNS", "HMS", "RFA", "HMCS", "TCG", "ORP", "NRP", "ITS", "ESPS", "HDMS", "HNLMS", "HNOMS", "HSWMS", "FGS", "NMS", "BNS", "HS", "SNS", "ROKS")
SHIP_ROLES = {35: ("warship", "military operations"), 55: ("law_enforcement", "law enforcement")}
UAV_TYPES = ("Q4", "Q9", "Q1", "Q25", "MQ9", "RQ4", "Q4C", "TB2", "TB3", "HRON", "H450", "AKN")
DESCRIBED = {"H": "helicopter", "T": "tiltrotor", "R": "tiltrotor", "G": "gyrocopter"}


def _map(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def _in(value: Column, names) -> Column:
    return F.array_contains(F.array(*map(F.lit, names)), value)


def designation(model: Column) -> Column:
    """Role, airframe and designation of the first mission designation in a model name; null without one.

    Every place that looks like a designation becomes an element; those that are maker codes, or follow another
    make's designation, or carry no mission, are filtered out of the array.
    """
    up = F.upper(model)
    shape = r"(?<![A-Z0-9])([A-Z]{1,4})-(\d{1,3})[A-Z]?\b"
    found = F.regexp_extract_all(up, F.lit(shape), F.lit(0))
    gaps = F.slice(F.split(up, shape, -1), 1, F.size(found))
    before = F.transform(gaps, lambda gap, i: F.concat(F.when(i > 0, F.try_element_at(found, i)).otherwise(F.lit("")), gap))
    after_other = rf"\b({'|'.join(SOVIET)})-?\d+[A-Z]*[\s-]*$"

    def read(z: Column) -> Column:
        letters, number = F.regexp_extract(z["hit"], r"^([A-Z]+)-", 1), F.regexp_extract(z["hit"], r"-(\d+)", 1)
        last = F.substring(letters, -1, 1)
        bare = (F.length(letters) == 1) & last.isin("Q", "V")
        vehicle = F.when(F.length(letters) > 1, F.element_at(_map(VEHICLE), last))
        mission = F.when(vehicle.isNotNull(), F.substring(letters, F.lit(1), F.length(letters) - 1)).otherwise(letters)
        stripped = F.regexp_replace(mission, f"^[{STATUS}]+", "")
        mission = F.when(stripped == "", mission).otherwise(stripped)
        role = F.element_at(_map(MISSION), F.substring(mission, 1, 1))
        name = F.concat(letters, F.lit("-"), number)
        good = ~_in(letters, NOT_MDS) & ~z["before"].rlike(after_other)
        return F.when(good & bare, F.struct(F.lit("unknown").alias("role"), F.element_at(_map(VEHICLE), last).alias("airframe"), name.alias("designation"))).when(
            good & role.isNotNull(), F.struct(role.alias("role"), vehicle.alias("airframe"), name.alias("designation")))

    return F.try_element_at(F.array_compact(F.transform(F.arrays_zip(before.alias("before"), found.alias("hit")), read)), F.lit(1))


def described(short_type: Column) -> Column:
    """Airframe by the first letter of a type description."""
    letter = F.nullif(F.substring(short_type, 1, 1), F.lit(""))
    return F.when(letter.isNotNull(), F.coalesce(F.try_element_at(_map(DESCRIBED), letter), F.lit("fixed_wing")))


def learned_roles(register: DataFrame, least: int = 3) -> DataFrame:
    """Role of each type code by a strict majority of the airframes whose model parses. register: type, model."""
    x = register.select("type", designation(F.col("model")).alias("d")).where("type IS NOT NULL AND d IS NOT NULL").groupBy("type", F.col("d.role").alias("role")).agg(F.count("*").alias("votes"))
    g = x.groupBy("type").agg(F.sum("votes").alias("parsed"), F.max_by("role", F.struct("votes", "role")).alias("role"), F.max("votes").alias("votes"))
    return g.where((F.col("votes") >= least) & (2 * F.col("votes") > F.col("parsed")))


def organisation(state: Column, reg: Column, operator: Column) -> Column:
    branch = F.lit(None).cast("string")
    for name, words in reversed(BRANCHES):
        branch = F.when(F.upper(operator).rlike(rf"\b(?:{'|'.join(words)})\b"), F.lit(name)).otherwise(branch)
    named = F.when(branch.isNotNull(), F.concat_ws(" ", state, branch))
    return F.when(F.upper(reg).startswith("LX-N"), F.lit("NATO")).otherwise(F.coalesce(named, F.concat(state, F.lit(" military"))))


def aircraft(live: DataFrame, register: DataFrame, blocks: DataFrame, known_types: DataFrame, military_feed: bool = False) -> DataFrame:
    """Classification of live aircraft: military, role, airframe, uav, state, org, family, designation, evidence.

    live: hex, type, flight, reg, flags, category, desc. register: hex, reg, type, model, operator, short_type.
    blocks: start, end, country, code. known_types: type, role, airframe; these win over designations, and those
    over roles learned from the register.
    """
    hex_ = F.regexp_replace(F.lower("hex"), "^~", "")
    reg = register.select("hex", F.col("reg").alias("_reg"), F.col("type").alias("_type"), F.col("model").alias("_model"), F.col("operator").alias("_op"), F.col("short_type").alias("_short"), F.lit(True).alias("_in"))
    x = live.withColumn("hex", hex_).join(reg, "hex", "left").withColumn("_t", F.upper(F.coalesce("type", "_type")))
    x = x.join(small(known_types.select(F.col("type").alias("_t"), F.col("role").alias("k_role"), F.col("airframe").alias("k_frame"))), "_t", "left")
    x = x.join(small(learned_roles(register).select(F.col("type").alias("_t"), F.col("role").alias("l_role"), "votes", "parsed")), "_t", "left")
    x = x.withColumn("_a", F.conv("hex", 16, 10).cast("long"))
    # Addresses are looked up once each, whatever number of rows carries them.
    states = narrowest_range(x.where("_a IS NOT NULL"), blocks, "_a", "start", "end", "country").select("_a", F.col("country").alias("state"), F.col("code").alias("state_code")).where("state_code IS NOT NULL")
    x = x.join(states, "_a", "left").withColumn("d", F.coalesce(designation(F.col("_model")), designation(F.col("desc"))))
    flag = F.coalesce("flags", F.lit(0)).bitwiseAND(1) == 1
    military = flag | F.coalesce("_in", F.lit(False)) | F.lit(military_feed)
    role = F.coalesce("k_role", "d.role", "l_role", F.lit("unknown"))
    frame = F.coalesce(F.col("k_frame"), F.when(F.col("k_role").isNull(), F.col("d.airframe")), F.lit("fixed_wing"))
    frame = F.when(frame != "fixed_wing", frame).when(described(F.col("_short")) != "fixed_wing", described(F.col("_short"))).when(F.col("category") == "A7", "helicopter").otherwise("fixed_wing")
    uav = F.coalesce(_in(F.col("_t"), UAV_TYPES), F.lit(False)) | F.coalesce(F.col("category") == "B6", F.lit(False)) | (frame == "uav")
    says = F.array_compact(F.array(
        F.when(flag, "military flag of the feed"), F.when(F.col("_in"), "in the military register"), F.when(F.lit(military_feed), "reported by a military-only feed"),
        F.when(F.col("k_role").isNotNull(), F.concat(F.lit("type "), F.col("_t"))).when(F.col("d").isNotNull(), F.concat(F.lit("designation "), F.col("d.designation"))).when(
            F.col("l_role").isNotNull(), F.format_string("type %s: %d/%d registered airframes are %s", "_t", "votes", "parsed", "l_role")),
        F.when(F.col("state").isNotNull(), F.concat(F.lit("address block of "), F.col("state"))), F.when(F.col("_op").isNotNull(), F.concat(F.lit("operator: "), F.col("_op")))))
    name = F.when(F.col("k_role").isNull() | (F.col("k_role") == F.col("d.role")), F.col("d.designation"))
    only = lambda c: F.when(military, c)
    return x.select(
        *live.columns, military.alias("military"), only(role).alias("role"), only(F.when(uav, "uav").otherwise(frame)).alias("airframe"), (military & uav).alias("uav"), only(F.col("state")).alias("state"), only(F.col("state_code")).alias("state_code"),
        only(organisation(F.col("state"), F.coalesce("reg", "_reg"), F.col("_op"))).alias("org"), only(text.family(F.upper("flight"))).alias("callsign_family"), only(name).alias("designation"), F.when(military, says).otherwise(F.array().cast("array<string>")).alias("evidence"))


def vessels(ships: DataFrame, digits: DataFrame) -> DataFrame:
    """Naval classification of ships. ships: mmsi, name, type_code. digits: mid, code, country."""
    mid = F.when(text.valid_mmsi(F.col("mmsi")), F.substring("mmsi", 1, 3))
    x = ships.withColumn("_mid", mid).join(small(digits.select(F.col("mid").alias("_mid"), "code", "country")), "_mid", "left")
    prefix = F.nullif(F.regexp_extract(F.upper(F.coalesce("name", F.lit(""))), rf"^({'|'.join(NAVY_PREFIXES)})\s", 1), F.lit(""))
    typed = F.lit(None).cast("string")
    word = F.lit(None).cast("string")
    for code, (role, label) in SHIP_ROLES.items():
        typed, word = F.when(F.col("type_code") == code, role).otherwise(typed), F.when(F.col("type_code") == code, label).otherwise(word)
    role = F.coalesce(typed, F.when(prefix.isNotNull(), "warship"))
    says = F.array_compact(F.array(F.when(typed.isNotNull(), F.concat(F.lit("ship type "), F.col("type_code").cast("string"), F.lit(" ("), word, F.lit(")"))), F.when(prefix.isNotNull(), F.concat(F.lit("navy name prefix "), prefix))))
    return x.select(*ships.columns, role.isNotNull().alias("military"), role.alias("naval_role"), F.col("country").alias("state"), F.col("code").alias("state_code"), F.when(role == "warship", F.concat(F.col("country"), F.lit(" Navy"))).alias("org"), says.alias("evidence"))
