"""Matching profiles to titles by the skills both name.

Offers are reduced once to a small table of title, country and skill; all
scopes, requirement sets and salaries come from that table. Profiles with the
same scope and skills share one computation.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offermarket.functions.numbers import (
    compat_badge,
    mean,
    money_text,
    percent_score,
    percent_text,
    report_grade,
)
from offermarket.skew import BROADCAST_BYTES, global_row_number, hot_join, measured_bytes, sized_join, spread
from offermarket.staging import stage
from offermarket.vocabulary import (
    ALL_COUNTRIES,
    FULL_PROFILE,
    NO_SKILL,
    NONE_MATCHED,
    NONE_MISSING,
)

_TITLE = ["scope", "job_title"]
# Profiles whose pairs with requirement sets one task counts and ranks in memory.
PROFILES_EACH = 5_000


def valid_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles with at least one skill; skills distinct and sorted.

    ``scope`` is the target country, or the "all countries" entry.
    """
    skills = F.array_sort(F.array_distinct(F.filter("skills", lambda skill: skill.isNotNull())))
    return (
        profiles.withColumn("skills", skills)
        .filter(F.size("skills") > 0)
        .withColumn("scope", F.coalesce("target_country", F.lit(ALL_COUNTRIES)))
    )


def scope_rows(rows: DataFrame, country: str | None = None) -> DataFrame:
    """Offer-skill rows of one country, or all of them."""
    if country is None or country == ALL_COUNTRIES:
        return rows
    return rows.filter(F.col("country") == F.lit(country))


def title_skills(rows: DataFrame) -> DataFrame:
    """``(scope, job_title, skill_name)`` with rows and salary sums.

    Rows are first reduced by country, title and skill, which is staged: every reduced row
    is one of its own country, and only those of "all countries" are added up again.
    """
    measures = [
        F.sum("salary_avg").alias("salaries"),
        F.count("salary_avg").alias("n_salaries"),
    ]
    reduced = (
        rows.filter(F.col("skill_name").isNotNull() & F.col("job_title").isNotNull())
        .groupBy("country", "job_title", "skill_name")
        .agg(*measures)
    )
    reduced = stage(reduced, "title-skills")
    everywhere = (
        reduced.groupBy(F.lit(ALL_COUNTRIES).alias("scope"), "job_title", "skill_name")
        .agg(F.sum("salaries").alias("salaries"), F.sum("n_salaries").alias("n_salaries"))
    )
    # NULL, and a country of that name, are no scope of their own.
    local = reduced.filter(F.col("country") != ALL_COUNTRIES).withColumnRenamed("country", "scope")
    return everywhere.unionByName(local)


def title_facts(rows: DataFrame) -> DataFrame:
    """Per scope and title: the required skills and the mean salary."""
    return (
        title_skills(rows)
        .groupBy(*_TITLE)
        .agg(
            F.array_sort(F.collect_list("skill_name")).alias("required"),
            mean(F.sum("salaries"), F.sum("n_salaries")).alias("mean_salary"),
        )
    )


def title_requirements(rows: DataFrame) -> DataFrame:
    """Per scope and title: all skills its offers name, sorted."""
    return title_facts(rows).select(*_TITLE, "required")


def title_salary(rows: DataFrame) -> DataFrame:
    """Per scope and title: mean salary over offer-skill rows.

    An offer weighs by the number of its skills, unlike in ``salary_by_title``.
    """
    return title_facts(rows).select(*_TITLE, "mean_salary")


def requirement_sets(requirements: DataFrame, n: int | None = 10) -> DataFrame:
    """The different requirement sets of each scope, with the first ``n`` titles that ask for each.

    Of titles with equal requirements only the first ``n`` by name can be among anybody's
    best ``n``; without ``n`` all are kept. Sets are numbered by their first title, so of equal
    scores the smaller number is the better.
    """
    asked = requirements.select(*_TITLE, "required")
    if n is not None:
        same = Window.partitionBy("scope", "required").orderBy("job_title")
        asked = asked.withColumn("_place", F.row_number().over(same)).filter(F.col("_place") <= n)
    sets = (
        asked.groupBy("scope", "required")
        .agg(F.array_sort(F.collect_list("job_title")).alias("titles"))
        .withColumn("_title", F.get("titles", F.lit(0)))
    )
    return global_row_number(sets, [F.asc("_title"), F.asc("scope")], "set").drop("_title")


def _sets_by_skill(sets: DataFrame) -> list[DataFrame]:
    """Per scope and skill, the numbers of the sets that ask for it, in parts that may be broadcast.

    A list of numbers per skill takes a fraction of a row per set and skill. What is
    beyond the bound is cut by set numbers, so each set is whole in one part.
    """
    def listed(some: DataFrame) -> DataFrame:
        skills = some.select("scope", F.col("set").cast("int").alias("set"), F.explode("required").alias("skill"))
        return stage(skills.groupBy("scope", "skill").agg(F.collect_list("set").alias("sets")), "sets-by-skill")

    whole = listed(sets)
    parts = -(-measured_bytes(whole) // (BROADCAST_BYTES // 2))
    if parts <= 1:
        return [whole]
    return [listed(sets.filter(F.pmod("set", F.lit(parts)) == part)) for part in range(parts)]


def coverage_score(
    profiles: DataFrame, requirements: DataFrame, method: str = "coverage", n: int | None = None
) -> DataFrame:
    """Score of every profile and title of its scope that share a skill.

    With ``n``, only the ``n`` best titles of a profile with a score, by score, then name,
    and their ``rank``.

    Skills are joined to lists of requirement sets, not to titles: shared skills are
    counted per profile and set number, and sets become titles afterwards. The lists
    are measured first and broadcast in parts of bounded size; as the profiles, which are
    read once per part and should be staged, are spread by their key beforehand,
    counting and ranking in a part need no further shuffle, whatever the number of pairs.
    """
    if method not in ("coverage", "dice"):
        raise ValueError(f"unknown method {method}")
    sets = stage(requirement_sets(requirements, n), "requirement-sets")
    facts = sets.select("set", "scope", F.size("required").alias("n_required"), "titles")
    owned = spread(profiles, "profile_id", rows_each=PROFILES_EACH).select(
        "profile_id", "scope", F.size("skills").alias("n_owned"), F.explode("skills").alias("skill")
    )
    if method == "coverage":
        score = percent_score(F.col("n_matched"), F.col("n_required"))
    else:
        score = percent_score(2 * F.col("n_matched"), F.col("n_owned") + F.col("n_required"))
    best_sets = Window.partitionBy("profile_id").orderBy(F.desc("score"), "set")

    def counted(lists: DataFrame) -> DataFrame:
        matched = (
            sized_join(owned, lists, ["scope", "skill"], ["profile_id"])
            .select("profile_id", "n_owned", F.explode("sets").alias("set"))
            .groupBy("profile_id", "n_owned", "set")
            .agg(F.count(F.lit(1)).alias("n_matched"))
        )
        scored = sized_join(matched, facts.select("set", "n_required"), ["set"], ["profile_id"]).withColumn("score", score)
        return scored if n is None else _first(scored.filter(F.col("score") > 0))

    def _first(scored: DataFrame) -> DataFrame:
        return scored.withColumn("_place", F.row_number().over(best_sets)).filter(F.col("_place") <= n).drop("_place")

    parts = [counted(lists) for lists in _sets_by_skill(sets)]
    found = reduce(DataFrame.unionByName, parts)
    if n is not None and len(parts) > 1:
        found = _first(found)
    named = sized_join(found, facts.select("set", "scope", "titles"), ["set"], ["profile_id"])
    titled = named.withColumn("job_title", F.explode("titles"))
    results = ["profile_id", *_TITLE, "n_matched", "n_required", "score"]
    if n is None:
        return titled.select(*results)
    best = Window.partitionBy("profile_id").orderBy(F.desc("score"), "job_title")
    return titled.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n).select(*results, "rank")


def recommend_titles(scored: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` titles of each profile, from ``coverage_score`` with as many or more."""
    return scored.filter(F.col("rank") <= n)


def scope_skills(facts: DataFrame) -> DataFrame:
    """Per scope the sorted ``names`` of the skills its titles ask for; a skill's number is its place among them."""
    asked = facts.select("scope", F.explode("required").alias("skill")).distinct()
    return asked.groupBy("scope").agg(F.array_sort(F.collect_list("skill")).alias("names"))


def numbered_lists(df: DataFrame, lists: str, names: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` with the sorted numbers of the skills in a row's ``lists``, a list of names.

    Rows are told apart by ``keys``; skills that no title of the scope asks for have no number.
    """
    numbers = stage(names.select("scope", F.posexplode("names").alias("number", "skill")), "skill-numbers")
    held = df.select("scope", *[key for key in keys if key != "scope"], F.explode(lists).alias("skill"))
    found = sized_join(held, numbers, ["scope", "skill"], [keys[-1]])
    return found.groupBy(*keys).agg(F.array_sort(F.collect_list("number")).alias(lists))


def with_title_facts(recommended: DataFrame, facts: DataFrame, limit: int | None = None) -> DataFrame:
    """Recommendations with the title's required skills and mean salary.

    ``facts`` are staged and measured, as their files tell little of what a list of skills
    takes in memory; beyond ``limit``, an eighth of ``BROADCAST_BYTES`` for lists of names, they
    are shuffled. A few titles are recommended to nearly everybody: only those are spread
    out. ``recommended`` is read twice then and should be staged.
    """
    wanted = facts.select(*_TITLE, "required", "mean_salary")
    if measured_bytes(wanted) <= (BROADCAST_BYTES // 8 if limit is None else limit):
        return recommended.join(F.broadcast(wanted), _TITLE)
    counts = stage(recommended.groupBy(*_TITLE).agg(F.count(F.lit(1)).alias("n_rows")), "title-counts")
    return hot_join(recommended, wanted.hint("merge"), counts, _TITLE, ["profile_id"])


def skill_gap(recommended: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Required skills the profile has and lacks, both sorted.

    ``recommended`` carries ``required`` and the profile's ``skills``; with ``names``, from
    ``scope_skills``, both are sorted numbers and become names here.
    """
    if names is not None:
        def named(numbers: Column | str) -> Column:
            return F.transform(numbers, lambda number: F.get("names", number))

        return (
            sized_join(recommended, names, ["scope"], ["profile_id"])
            .withColumn("matched", named(F.array_intersect("required", "skills")))
            .withColumn("missing", named(F.array_except("required", "skills")))
            .withColumn("required", named("required"))
            .drop("skills", "names")
        )
    return (
        recommended.withColumn("matched", F.array_sort(F.array_intersect("required", "skills")))
        .withColumn("missing", F.array_sort(F.array_except("required", "skills")))
        .drop("skills")
    )


def same_profiles(profiles: DataFrame) -> DataFrame:
    """Valid profiles with ``basket``, equal for profiles that match alike."""
    return valid_profiles(profiles).withColumn(
        "basket", F.md5(F.to_json(F.struct("scope", "skills")))
    )


def baskets_of(keyed: DataFrame) -> DataFrame:
    """One row per basket, keyed like a profile, with its number of profiles."""
    return (
        keyed.groupBy("basket", "scope", "skills")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumnRenamed("basket", "profile_id")
    )


def spread_to_profiles(keyed: DataFrame, baskets: DataFrame, found: DataFrame, *carried: str) -> DataFrame:
    """What was found per basket, for every profile, with its ``carried`` columns; popular baskets are split."""
    return hot_join(
        keyed.select("profile_id", "basket", *carried),
        found.withColumnRenamed("profile_id", "basket"),
        baskets.select(F.col("profile_id").alias("basket"), "n_rows"),
        ["basket"],
        spread_by=["profile_id"],
    ).drop("basket")


def best_title(recommended: DataFrame) -> DataFrame:
    """The first title of each profile; salary as text, N/A when unknown."""
    return recommended.filter(F.col("rank") == 1).select(
        "profile_id", "job_title", "score", money_text(F.col("mean_salary")).alias("salary")
    )


def _joined(skills: str, otherwise: str):
    return F.when(F.size(skills) == 0, otherwise).otherwise(F.concat_ws(", ", skills))


def recap_table(recommended: DataFrame, n: int = 5) -> DataFrame:
    """The first titles of each profile as display texts."""
    return recommended.filter(F.col("rank") <= n).select(
        "profile_id",
        "rank",
        "job_title",
        percent_text(F.col("score")).alias("score"),
        compat_badge(F.col("score")).alias("level"),
        _joined("matched", NO_SKILL).alias("matched"),
        _joined("missing", FULL_PROFILE).alias("missing"),
        money_text(F.col("mean_salary")).alias("salary"),
    )


def profile_report(
    recommended: DataFrame, profiles: DataFrame, gap: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """One nested row per profile: the content of its report.

    A profile has at most the recommended titles, so the list is bounded. Lists of
    skills are only made for the first title. With ``gap``, which adds salary and lists to
    ``recommended``, they are made when all else is joined and are not shuffled; only
    where several profiles share an id must they be compared first. ``profiles`` are read
    more than once and should be staged.
    """
    line = F.struct(
        "rank",
        "job_title",
        "score",
        report_grade(F.col("score")).alias("grade"),
        money_text(F.col("mean_salary")).alias("salary"),
    )
    detail = F.struct(
        "job_title",
        _joined("matched", NONE_MATCHED).alias("matched"),
        _joined("missing", NONE_MISSING).alias("missing"),
    )
    complete = recommended if gap is None else gap(recommended)
    titles = complete.groupBy("profile_id").agg(F.array_sort(F.collect_list(line)).alias("titles"))
    header = valid_profiles(profiles).select(
        "profile_id",
        F.concat_ws(", ", "skills").alias("skills"),
        F.col("scope").alias("target_country"),
    )
    several = profiles.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)
    if gap is None or not several.isEmpty():
        first = complete.filter(F.col("rank") == 1).groupBy("profile_id").agg(F.max(detail).alias("best"))
        return header.join(titles, "profile_id").join(first, "profile_id")
    first = recommended.filter(F.col("rank") == 1).select("profile_id", "scope", "job_title", "skills")
    whole = header.withColumnRenamed("skills", "_skills").join(titles, "profile_id").join(first, "profile_id")
    return gap(whole).select("profile_id", F.col("_skills").alias("skills"), "target_country", "titles", detail.alias("best"))
