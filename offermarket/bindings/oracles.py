"""DuckDB SQL giving the result each query has to give."""

from __future__ import annotations

from offermarket.bindings.oracle_tables import percent_score, with_tables
from offermarket.bindings.queries import CUES, PART_WORDS, VECTOR_COLUMNS, WORDS
from offermarket.bindings.tables import BASE_YEAR, COUNTRY, YEARS
from offermarket.schemas import FOREIGN_KEYS, MAX_LENGTH, NOT_NULL, UNIQUE
from offermarket.vocabulary import (
    ALL_COUNTRIES,
    API_SOURCE,
    CATEGORICAL_COLUMNS,
    FULL_PROFILE,
    MARKET_SOURCE,
    MONTH_LABELS,
    NO_SKILL,
    NONE_MATCHED,
    NONE_MISSING,
    PREDICTION_FAILED,
    SEED_COUNTRIES,
    SEED_SKILLS,
    SOURCE_GENERAL,
    SOURCE_PREDICTION,
    UNCATEGORISED,
)

ORACLES: dict[str, str] = {}


def oracle(name: str, body: str, *needed: str) -> None:
    ORACLES[name] = with_tables(list(needed), body)


def literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


MARKET = f"source = '{MARKET_SOURCE}'"
PRICED = f"{MARKET} AND salary_avg IS NOT NULL"
MEAN = "CAST(sum(salary_avg) AS DOUBLE) / count(salary_avg)"
# Row of events as loaded: errors come without a key.
ARRIVALS = """(SELECT CASE WHEN event_type <> 'error' THEN user_id END AS user_id,
                      event_type, ts, event_id FROM events)"""
COUNTRY_OF = """CASE {0} WHEN 'NATION_1' THEN 'NATION_0' WHEN 'NATION_3' THEN 'NATION_99'
                WHEN 'NATION_2' THEN NULL ELSE {0} END"""
FEED = """(SELECT o_orderkey AS job_id, CASE WHEN c_acctbal >= 0 THEN n_name END AS country,
                  c_name AS company_name
           FROM orders JOIN customer ON o_custkey = c_custkey
                JOIN nation ON c_nationkey = n_nationkey)"""
KNOWN = "(SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE n_nationkey < 20)"
SPACES = r"E'\t\n\r '"


def money_text(amount: str, otherwise: str = "'N/A'") -> str:
    return (
        f"CASE WHEN {amount} > 0 THEN '$' || format('{{:,}}', "
        f"CAST(round_even({amount}, 0) AS BIGINT)) ELSE {otherwise} END"
    )


def score_text(score: str) -> str:
    return f"format('{{:.1f}}', {score}) || '%'"


def level(score: str) -> str:
    return (
        f"CASE WHEN {score} >= 50 THEN '🟢 Excellent' WHEN {score} >= 25 THEN '🟡 Bon' "
        f"ELSE '🔴 Moyen' END"
    )


# --- sources ------------------------------------------------------------------

_CUSTOMER = [
    ("c_custkey", "bigint"),
    ("c_name", "string"),
    ("c_nationkey", "int"),
    ("c_acctbal", "double"),
    ("c_mktsegment", "string"),
]
oracle(
    "profile_source",
    " UNION ALL ".join(
        f"SELECT {i + 1} AS position, '{name}' AS \"column\", '{kind}' AS dtype, "
        f"count(*) AS n_rows, count(*) - count({name}) AS n_null, TRUE AS distinct_is_near FROM customer"
        for i, (name, kind) in enumerate(_CUSTOMER)
    ),
)

# --- load semantics -----------------------------------------------------------

oracle(
    "first_wins",
    f"""SELECT CAST(user_id AS VARCHAR) AS user_id, event_type, event_id
        FROM {ARRIVALS} WHERE user_id IS NULL
        UNION ALL
        SELECT CAST(user_id AS VARCHAR), event_type, event_id FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn
            FROM {ARRIVALS} WHERE user_id IS NOT NULL) WHERE rn = 1""",
)
oracle(
    "insert_if_absent",
    f"""SELECT CAST(user_id AS VARCHAR) AS user_id, event_type, event_id
        FROM {ARRIVALS} WHERE user_id IS NULL
        UNION ALL
        SELECT CAST(user_id AS VARCHAR), event_type, event_id FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn
            FROM {ARRIVALS} WHERE user_id IS NOT NULL) a
        WHERE rn = 1 AND NOT (event_type = 'purchase'
              AND user_id IN (SELECT user_id FROM events WHERE value > 50))""",
)
oracle(
    "insert_job_skills",
    """SELECT DISTINCT l_orderkey AS job_id, l_partkey AS skill_id FROM lineitem
       EXCEPT
       SELECT l_orderkey, l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'""",
)
oracle(
    "delete_cascade",
    """SELECT js.job_id, s.name
       FROM job_skills js JOIN skills s ON js.skill_id = s.id
            JOIN jobs j ON js.job_id = j.id
       WHERE j.country_id IS NOT NULL""",
    "job_skills",
    "skills",
    "jobs",
)

_BOUND_COLUMNS = {
    "countries": ["id", "code", "name", "continent"],
    "companies": ["id", "name", "size", "country_id"],
    "skills": ["id", "name", "category"],
    "jobs": [
        "id", "external_id", "source", "job_title", "job_category", "company_id", "country_id",
        "salary_avg", "experience_level", "years_of_experience", "employment_type",
        "is_remote_friendly", "company_size", "industry", "posting_year", "posting_month",
    ],
    "job_skills": ["job_id", "skill_id"],
}


def _rules() -> str:
    parts = []

    def rule(name: str, table: str, count: str) -> None:
        parts.append(
            f"SELECT {literal(name)} AS rule, '{table}' AS \"table\", "
            f"CAST(({count}) AS BIGINT) AS n_violations"
        )

    for table, columns in _BOUND_COLUMNS.items():
        for column in NOT_NULL[table]:
            if column in columns:
                rule(
                    f"not null {column}", table, f"SELECT count(*) FROM {table} WHERE {column} IS NULL"
                )
        for column, limit in MAX_LENGTH[table].items():
            if column in columns:
                rule(
                    f"length {column} <= {limit}",
                    table,
                    f"SELECT count(*) FROM {table} WHERE length({column}) > {limit}",
                )
        for keys in UNIQUE[table]:
            present = " AND ".join(f"{key} IS NOT NULL" for key in keys)
            rule(
                f"unique {', '.join(keys)}",
                table,
                f"SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {table} "
                f"WHERE {present} GROUP BY {', '.join(keys)})",
            )
    for child, key, parent in FOREIGN_KEYS:
        rule(
            f"foreign key {key}",
            child,
            f"SELECT count(*) FROM {child} WHERE {key} IS NOT NULL "
            f"AND {key} NOT IN (SELECT id FROM {parent})",
        )
    return " UNION ALL ".join(parts)


oracle("check_constraints", _rules(), *_BOUND_COLUMNS)
oracle(
    "load_report",
    """, counts AS (
           SELECT (SELECT count(*) FROM events) AS n_read,
                  (SELECT count(*) FROM events WHERE event_type <> 'error') AS n_accepted,
                  (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events
                                         WHERE event_type <> 'error')) AS n_new,
                  (SELECT count(*) FROM job_skills) AS n_pairs)
       SELECT 'read' AS metric, n_read AS n FROM counts
       UNION ALL SELECT 'accepted', n_accepted FROM counts
       UNION ALL SELECT 'rejected', n_read - n_accepted FROM counts
       UNION ALL SELECT 'inserted', n_new FROM counts
       UNION ALL SELECT 'job_skills inserted', n_pairs FROM counts
       UNION ALL SELECT 'duplicate', n_accepted - n_new FROM counts""",
    "job_skills",
)
oracle(
    "table_counts",
    """SELECT 'countries' AS "table", NULL AS source, count(*) AS n FROM countries
       UNION ALL SELECT 'companies', NULL, count(*) FROM companies
       UNION ALL SELECT 'skills', NULL, count(*) FROM skills
       UNION ALL SELECT 'jobs', source, count(*) FROM jobs GROUP BY source
       UNION ALL SELECT 'job_skills', NULL, count(*) FROM job_skills""",
    *_BOUND_COLUMNS,
)

# --- conforming ---------------------------------------------------------------

oracle(
    "normalize_country",
    f"SELECT n_name, {COUNTRY_OF.format('n_name')} AS country FROM nation",
)
oracle(
    "split_known_country",
    f"""SELECT job_id, canonical AS country_name, k.id AS country_id,
               f.country IS NOT NULL AND (canonical IS NULL OR k.id IS NOT NULL) AS accepted
        FROM (SELECT *, {COUNTRY_OF.format('country')} AS canonical FROM {FEED}) f
             LEFT JOIN {KNOWN} k ON k.name = f.canonical""",
)
oracle(
    "add_missing_countries",
    f"""SELECT DISTINCT CAST(NULL AS VARCHAR) AS code, canonical AS name,
               CAST(NULL AS VARCHAR) AS continent
        FROM (SELECT {COUNTRY_OF.format('country')} AS canonical FROM {FEED})
        WHERE canonical IS NOT NULL AND canonical NOT IN (SELECT name FROM {KNOWN})""",
)
oracle(
    "upsert_companies",
    """SELECT DISTINCT c_name AS name, CAST(NULL AS VARCHAR) AS size,
              CAST(c_nationkey AS VARCHAR) AS country_id
       FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0""",
)
oracle(
    "upsert_skills",
    """SELECT name, CAST(NULL AS VARCHAR) AS category FROM (
           SELECT p_brand || ' ' || p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey
           EXCEPT
           SELECT p_brand || ' ' || p_name FROM part WHERE p_size < 10)""",
)
oracle(
    "conform_market",
    f"""SELECT j.external_id, '{MARKET_SOURCE}' AS source, job_title, k.id AS country_id,
               CAST(salary_avg AS DOUBLE) AS salary_avg, 'USD' AS salary_currency, company_size,
               is_remote_friendly, posting_year, posting_month
        FROM (SELECT jobs.*, countries.name AS raw, {COUNTRY_OF.format('countries.name')} AS canonical
              FROM jobs LEFT JOIN countries ON country_id = countries.id) j
             LEFT JOIN {KNOWN} k ON k.name = j.canonical
        WHERE posting_year IS NOT NULL AND raw IS NOT NULL
              AND (canonical IS NULL OR k.id IS NOT NULL)""",
    "jobs",
    "countries",
)
oracle(
    "conform_api",
    f""", described AS (SELECT job_id, string_agg(skill_id, ', ' ORDER BY skill_id) AS description
                       FROM job_skills GROUP BY job_id)
        SELECT CAST(o_orderkey AS VARCHAR) AS external_id, '{API_SOURCE}' AS source,
               o_orderpriority AS job_title, o_orderstatus AS job_category,
               CASE WHEN k.id = CAST(c_nationkey AS VARCHAR) THEN CAST(c_custkey AS VARCHAR) END AS company_id,
               k.id AS country_id, f.country AS city, o_totalprice AS salary_min,
               CASE WHEN f.country = '{COUNTRY}' THEN 'GBP' ELSE 'USD' END AS salary_currency,
               o_orderstatus = 'O' AS salary_is_predicted, 'permanent' AS employment_type,
               d.description, CAST(o_orderdate AS DATE) AS posted_date
        FROM orders JOIN customer ON o_custkey = c_custkey
             JOIN (SELECT *, {COUNTRY_OF.format('country')} AS canonical FROM {FEED}) f
                  ON f.job_id = o_orderkey
             LEFT JOIN {KNOWN} k ON k.name = f.canonical
             LEFT JOIN described d ON d.job_id = CAST(o_orderkey AS VARCHAR)""",
    "job_skills",
)
oracle(
    "derive_currency",
    f"SELECT n_name, CASE WHEN n_name = '{COUNTRY}' THEN 'GBP' ELSE 'USD' END AS currency FROM nation",
)
oracle(
    "parse_posted_date",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(ts AS DATE) END AS posted_date
       FROM events""",
)
oracle("flag_predicted_salary", "SELECT event_id, event_type = 'view' AS is_predicted FROM events")
oracle(
    "coerce_flag",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'true' WHEN 'click' THEN 'false' END AS flag
       FROM events""",
)
oracle(
    "union_sources",
    """SELECT o_orderkey AS key, o_totalprice AS salary_avg, CAST(NULL AS VARCHAR) AS company FROM orders
       UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier""",
)
oracle(
    "apply_defaults",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id,
              CASE WHEN o_orderstatus <> 'P' THEN 'GBP' END AS salary_currency,
              false AS salary_is_predicted
       FROM orders""",
)
oracle(
    "assign_keys",
    """SELECT count(*) AS n_rows, count(DISTINCT p_brand || ' ' || p_name) AS n_keys,
              count(DISTINCT p_brand || ' ' || p_name) AS n_pairs
       FROM lineitem JOIN part ON l_partkey = p_partkey""",
)

# --- skills -------------------------------------------------------------------


def _has_word(word: str, column: str = "text") -> str:
    pattern = rf"(?i)(^|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]){word}([^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]|$)"
    return f"regexp_matches({column}, {literal(pattern)})"


_DETECTED = ", ".join(
    f"CASE WHEN {_has_word(word)} THEN {literal(word)} END" for word in WORDS
)
oracle("detect_skills", f"SELECT doc_id, concat_ws(',', {_DETECTED}) AS skills FROM documents")
oracle(
    "split_skill_list",
    "SELECT p_partkey, p_brand || ',' || p_type AS skills FROM part",
)
oracle(
    "offers_with_raw_skills",
    "SELECT 'p' || p_partkey AS id FROM part WHERE p_type NOT IN ('PROMO', 'SMALL')",
)
oracle(
    "build_job_skills",
    "SELECT 'p' || p_partkey AS job_id, p_brand AS name FROM part "
    "WHERE p_type NOT IN ('PROMO', 'SMALL')"
    + "".join(
        f" UNION ALL SELECT 'd' || doc_id, {literal(word)} FROM documents WHERE {_has_word(word)}"
        for word in WORDS
    ),
)

# --- views --------------------------------------------------------------------

oracle("skills_catalog", "SELECT name, category FROM skills", "skills")
oracle(
    "priced_offers",
    "SELECT * REPLACE (CAST(salary_avg AS DOUBLE) AS salary_avg) FROM priced",
    "priced",
)
oracle(
    "offer_skill_rows",
    "SELECT * REPLACE (CAST(salary_avg AS DOUBLE) AS salary_avg) FROM rows_",
    "rows_",
)
oracle("country_names", "SELECT n_name AS name FROM nation")
oracle(
    "offers_listing",
    """SELECT DISTINCT job_title, country, CAST(salary_avg AS DOUBLE) AS salary_avg, experience_level
       FROM priced""",
    "priced",
)
oracle(
    "skills_listing",
    f"SELECT DISTINCT name, coalesce(category, {literal(UNCATEGORISED)}) AS category FROM skills",
    "skills",
)
for _name, _key in [("title_summary", "job_title"), ("country_summary", "country")]:
    oracle(
        _name,
        f"""SELECT {_key}, count(*) AS n_offers, round_even({MEAN}, 0) AS mean_salary
            FROM priced WHERE {_key} IS NOT NULL GROUP BY {_key}""",
        "priced",
    )
oracle(
    "headline_kpis",
    """SELECT 'total offers' AS metric, count(*) AS value FROM jobs
       UNION ALL SELECT 'priced offers', count(*) FROM priced
       UNION ALL SELECT 'titles', count(DISTINCT job_title) FROM priced
       UNION ALL SELECT 'skills', count(*) FROM skills
       UNION ALL SELECT 'countries', count(DISTINCT name) FROM countries
       UNION ALL SELECT 'companies', count(DISTINCT c.name)
                 FROM jobs j JOIN companies c ON j.company_id = c.id""",
    "jobs",
    "priced",
    "skills",
    "countries",
    "companies",
)
oracle(
    "profile_options",
    f"""SELECT DISTINCT 'skill' AS kind, name AS value FROM skills
        UNION ALL SELECT DISTINCT 'country', name FROM countries
        UNION ALL SELECT 'country', {literal(ALL_COUNTRIES)}""",
    "skills",
    "countries",
)

# --- market -------------------------------------------------------------------

oracle(
    "top_skills",
    """SELECT name, n_offers FROM (
           SELECT concat_ws(' ', p_brand, p_name) AS name, count(DISTINCT l_orderkey) AS n_offers
           FROM part, lineitem WHERE p_partkey = l_partkey GROUP BY ALL)
       ORDER BY n_offers DESC, name LIMIT 10""",
)
oracle(
    "salary_by_title",
    f"""SELECT job_title, {MEAN} AS mean_salary, count(*) AS n_offers FROM jobs WHERE {PRICED}
        GROUP BY job_title ORDER BY mean_salary DESC, job_title LIMIT 15""",
    "jobs",
)
oracle(
    "offers_by_country",
    """SELECT n_name AS country, CAST(sum(n) AS BIGINT) AS n_offers
       FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) bought, customer, nation
       WHERE o_custkey = c_custkey AND c_acctbal >= 0 AND c_nationkey = n_nationkey GROUP BY n_name""",
)
oracle(
    "remote_split",
    f"""SELECT is_remote_friendly, count(*) AS n_offers,
               100e0 * count(*) / CAST(sum(count(*)) OVER () AS BIGINT) AS percent,
               CASE WHEN is_remote_friendly THEN 'Remote Friendly' ELSE 'Non Remote' END AS label
        FROM jobs WHERE {MARKET} AND is_remote_friendly IS NOT NULL GROUP BY is_remote_friendly""",
    "jobs",
)
_TREND = f"""SELECT posting_year, posting_month, count(*) AS n_offers FROM jobs
             WHERE {MARKET} AND posting_year IS NOT NULL AND posting_month IS NOT NULL
             GROUP BY posting_year, posting_month"""
oracle("monthly_trend", _TREND, "jobs")
oracle(
    "trend_axis",
    f"""SELECT posting_year, posting_month, n_offers,
               (posting_year - {BASE_YEAR}) * 12 + posting_month AS month_index,
               [{', '.join(literal(label) for label in MONTH_LABELS)}][posting_month]
                   || ' ' || posting_year AS period
        FROM ({_TREND}) WHERE posting_year IN ({YEARS[0]}, {YEARS[1]})""",
    "jobs",
)
_SKILL_TREND = """SELECT concat_ws(' ', p_brand, p_name) AS skill_name,
                          CAST(year(o_orderdate) AS INTEGER) AS posting_year,
                          count(DISTINCT o_orderkey) AS n_offers
                   FROM (SELECT * FROM orders WHERE o_orderstatus <> 'P') dated, lineitem, part
                   WHERE l_orderkey = o_orderkey AND p_partkey = l_partkey GROUP BY ALL"""
oracle("skill_trend_by_year", _SKILL_TREND)
oracle(
    "skill_trend_top",
    f"""SELECT * FROM ({_SKILL_TREND}) WHERE skill_name IN (SELECT name FROM ({ORACLES["top_skills"]}))""",
)
oracle(
    "top_companies",
    """SELECT name, n_offers FROM (
           SELECT c_name AS name, CAST(sum(n) AS BIGINT) AS n_offers
           FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) pending, customer
           WHERE o_custkey = c_custkey GROUP BY c_name)
       ORDER BY n_offers DESC, name LIMIT 15""",
)
oracle(
    "company_size_split",
    """SELECT company_size, count(*) AS n_offers,
              100e0 * count(*) / CAST(sum(count(*)) OVER () AS BIGINT) AS percent,
              CASE company_size WHEN 'S' THEN 'Startup (1-50)' WHEN 'M' THEN 'Mid-size (51-500)'
                   WHEN 'L' THEN 'Large (500+)' ELSE company_size END AS label
       FROM jobs WHERE company_size IS NOT NULL GROUP BY company_size""",
    "jobs",
)
for _name, _where in [
    ("salary_by_title_in_country", f"AND c.name = '{COUNTRY}'"),
    ("salary_by_title_everywhere", ""),
]:
    oracle(
        _name,
        f"""SELECT job_title, round_even(mean_salary, 0) AS mean_salary FROM (
                SELECT job_title, {MEAN} AS mean_salary
                FROM jobs j LEFT JOIN countries c ON j.country_id = c.id
                WHERE {PRICED} {_where} GROUP BY job_title
                ORDER BY mean_salary DESC, job_title LIMIT 15)""",
        "jobs",
        "countries",
    )
oracle(
    "skill_year_compare",
    f"""SELECT skill_name,
               CAST(coalesce(sum(n_offers) FILTER (posting_year = {YEARS[0]}), 0) AS BIGINT)
                   AS offers_{YEARS[0]},
               CAST(coalesce(sum(n_offers) FILTER (posting_year = {YEARS[1]}), 0) AS BIGINT)
                   AS offers_{YEARS[1]}
        FROM ({_SKILL_TREND}) WHERE posting_year IN ({YEARS[0]}, {YEARS[1]}) GROUP BY skill_name""",
)

# --- matching -----------------------------------------------------------------

oracle(
    "valid_profiles",
    """SELECT p.profile_id, string_agg(skill, '|' ORDER BY skill) AS skills, scope,
              c_mktsegment AS experience, c_acctbal AS min_salary
       FROM profile_skills p JOIN customer ON profile_id = c_custkey GROUP BY ALL""",
    "profile_skills",
)
oracle(
    "scope_rows",
    f"SELECT job_id, job_title, skill_name FROM rows_ WHERE country = '{COUNTRY}'",
    "rows_",
)
oracle(
    "title_requirements",
    """SELECT scope, job_title, string_agg(skill, '|' ORDER BY skill) AS required
       FROM needed GROUP BY scope, job_title""",
    "needed",
)
oracle("title_salary", "SELECT scope, job_title, mean_salary FROM facts", "facts")
oracle(
    "coverage_score",
    "SELECT profile_id, scope, job_title, n_matched, score FROM scored",
    "scored",
)
oracle(
    "dice_score",
    f"""SELECT profile_id, job_title,
               {percent_score('(2 * n_matched)', '(n_owned + n_required)')} AS score
        FROM scored""",
    "scored",
)
oracle("recommend_titles", "SELECT profile_id, rank, job_title, score FROM recs", "recs")
oracle(
    "match_profiles", "SELECT profile_id, rank, job_title, score, mean_salary FROM recs", "recs"
)
oracle(
    "best_title",
    f"""SELECT profile_id, job_title, score, {money_text('mean_salary')} AS salary
        FROM recs WHERE rank = 1""",
    "recs",
)
oracle("compat_badge", f"SELECT profile_id, rank, {level('score')} AS level FROM recs", "recs")
oracle("skill_gap", "SELECT profile_id, rank, job_title, matched, missing FROM matched", "matched")
oracle(
    "recap_table",
    f"""SELECT profile_id, rank, job_title, {score_text('score')} AS score, {level('score')} AS level,
               CASE WHEN matched = '' THEN '{NO_SKILL}' ELSE matched END AS matched,
               CASE WHEN missing = '' THEN '{FULL_PROFILE}' ELSE missing END AS missing,
               {money_text('mean_salary')} AS salary
        FROM matched WHERE rank <= 5""",
    "matched",
)
oracle(
    "profile_report",
    f""", own AS (SELECT profile_id, scope, string_agg(skill, ', ' ORDER BY skill) AS skills
                  FROM profile_skills GROUP BY ALL)
        SELECT m.profile_id, own.skills, own.scope AS target_country,
               string_agg(rank || ' ' || job_title || ' ' ||
                   CASE WHEN score >= 50 THEN 'EXCELLENT' WHEN score >= 25 THEN 'BON' ELSE 'MOYEN' END
                   || ' ' || {money_text('mean_salary')}, '; ' ORDER BY rank) AS titles,
               max(job_title) FILTER (rank = 1) AS best_title,
               max(CASE WHEN matched = '' THEN '{NONE_MATCHED}' ELSE matched END)
                   FILTER (rank = 1) AS matched,
               max(CASE WHEN missing = '' THEN '{NONE_MISSING}' ELSE missing END)
                   FILTER (rank = 1) AS missing
        FROM matched m JOIN own ON own.profile_id = m.profile_id
        GROUP BY m.profile_id, own.skills, own.scope""",
    "matched",
    "profile_skills",
)

# --- career plan --------------------------------------------------------------

oracle("skill_demand", "SELECT skill_name, n_offers FROM demand", "demand")
oracle("priority_skills", "SELECT profile_id, rank, skill_name, n_offers FROM priority", "priority")
oracle(
    "hiring_countries",
    """SELECT profile_id, rank, country, n_offers FROM (
           SELECT profile_id, country, n_offers, row_number() OVER (
                  PARTITION BY profile_id ORDER BY n_offers DESC, country) AS rank
           FROM (SELECT p.profile_id, r.country, count(DISTINCT r.job_id) AS n_offers
                 FROM profile_skills p JOIN rows_ r ON r.skill_name = p.skill
                 WHERE r.country IS NOT NULL GROUP BY p.profile_id, r.country))
       WHERE rank <= 10""",
    "profile_skills",
    "rows_",
)
ORACLES["career_plan_skills"] = ORACLES["priority_skills"]
ORACLES["career_plan_countries"] = ORACLES["hiring_countries"]
oracle(
    "skill_salary_impact",
    f""", paid AS (SELECT skill_name, {MEAN} AS mean_salary FROM rows_
                   WHERE salary_avg IS NOT NULL GROUP BY skill_name)
        SELECT profile_id, skill_name, round_even(mean_salary, 0) AS mean_salary,
               row_number() OVER (PARTITION BY profile_id
                   ORDER BY round_even(mean_salary, 0) DESC, skill_name) AS rank
        FROM priority JOIN paid USING (skill_name) WHERE rank <= 10 AND mean_salary > 0""",
    "priority",
    "rows_",
)

# --- salary features ----------------------------------------------------------

oracle(
    "training_extract",
    "SELECT * REPLACE (CAST(salary_avg AS DOUBLE) AS salary_avg) FROM extract",
    "extract",
)
oracle(
    "salary_range",
    """SELECT id, CAST(salary_avg AS DOUBLE) AS salary_avg FROM extract
       WHERE salary_avg > 5000 AND salary_avg < 500000""",
    "extract",
)
oracle(
    "bucket_rare",
    """SELECT id, CASE WHEN count(*) OVER (PARTITION BY job_title) < 50 THEN 'Other'
                  ELSE job_title END AS job_title
       FROM extract WHERE salary_avg > 5000 AND salary_avg < 500000""",
    "extract",
)
oracle("skills_list", "SELECT p_partkey, p_brand || '|' || p_type AS skills FROM part")
oracle(
    "log_target",
    """SELECT o_orderkey, round_even(ln(1 + o_totalprice), 6) AS logged, o_totalprice AS back
       FROM orders""",
)
oracle(
    "split_train_test",
    """SELECT id, CASE WHEN CAST('0x' || substr(md5(id || ':42'), 1, 8) AS BIGINT) % 100 < 80
                  THEN 'train' ELSE 'test' END AS part
       FROM extract""",
    "extract",
)
oracle(
    "format_salary",
    f"SELECT o_orderkey, {money_text('o_totalprice')} || ' USD/an' AS salary FROM orders",
)

# --- conversations ------------------------------------------------------------

oracle(
    "strip_think",
    f"SELECT conv_id, turn, trim(text, {SPACES}) AS text FROM conversations",
)
oracle(
    "extract_salary_request",
    """SELECT event_id, event_type NOT IN ('error', 'click') AS is_request,
              CASE WHEN event_type NOT IN ('error', 'click')
                   THEN json_extract_string(props, '$.k') END AS k
       FROM events""",
)
_INTENT = " OR ".join(f"contains(lower(text), {literal(cue.lower())})" for cue in CUES)
oracle(
    "route_intent",
    f"SELECT conv_id, turn, CASE WHEN {_INTENT} THEN 'ML' ELSE 'GENERAL' END AS intent FROM conversations",
)
oracle(
    "context_window",
    r"""SELECT conv_id, turn, coalesce(string_agg(role || ': ' || text, E'\n--\n') OVER (
               PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context
        FROM conversations""",
)
oracle(
    "append_turns",
    """WITH last AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id),
         new AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place
                 FROM conversations WHERE role = 'user')
       SELECT conv_id, turn, role, text FROM conversations
       UNION ALL SELECT conv_id, last + 2 * place - 1, 'user', text FROM new JOIN last USING (conv_id)
       UNION ALL SELECT conv_id, last + 2 * place, 'assistant', text FROM new JOIN last USING (conv_id)""",
)
oracle(
    "tag_source",
    f"""SELECT conv_id, turn, text || CASE WHEN {_INTENT} THEN {literal(SOURCE_PREDICTION)}
                                    ELSE {literal(SOURCE_GENERAL)} END AS text
        FROM conversations""",
)

# --- model features -----------------------------------------------------------

oracle("encode_skills", "SELECT id, skills FROM extract", "extract")
oracle(
    "encode_categories",
    "SELECT id, "
    + ", ".join(f"coalesce(CAST({name} AS VARCHAR), '') AS {name}" for name in VECTOR_COLUMNS)
    + " FROM extract",
    "extract",
)
_FLAGS = ", ".join(f"'{name}_flags_' || CAST({name} AS VARCHAR)" for name in CATEGORICAL_COLUMNS)
oracle(
    "assemble",
    f"""SELECT id, array_to_string(list_sort(list_filter([{_FLAGS}], lambda f: f IS NOT NULL)), ',') AS flags,
               CAST(years_of_experience AS DOUBLE) AS years FROM extract""",
    "extract",
)
_IN_RANGE = "salary_avg > 5000 AND salary_avg < 500000"
oracle(
    "training_report",
    f"""SELECT 'offers' AS metric, count(*) AS n FROM extract
        UNION ALL SELECT 'salary out of range', count(*) FILTER (NOT ({_IN_RANGE})) FROM extract
        UNION ALL SELECT 'years missing', count(*) FILTER ({_IN_RANGE} AND years_of_experience IS NULL) FROM extract
        UNION ALL SELECT 'trained on', count(*) FILTER ({_IN_RANGE} AND years_of_experience IS NOT NULL) FROM extract"""
    + "".join(
        f" UNION ALL SELECT 'unused {name}', CAST(count({name}) FILTER ({_IN_RANGE}) = 0 AS BIGINT) FROM extract"
        for name in CATEGORICAL_COLUMNS
    ),
    "extract",
)
oracle(
    "linear_baseline",
    f"""SELECT 'slope' AS part, round_even(regr_slope(ln(1 + salary_avg), years_of_experience), 6) AS value
        FROM extract WHERE {_IN_RANGE}
        UNION ALL SELECT 'intercept', round_even(regr_intercept(ln(1 + salary_avg), years_of_experience), 6)
        FROM extract WHERE {_IN_RANGE}""",
    "extract",
)
for _name, _label in [("search_forest", "forest"), ("search_boosted", "boosted"), ("reduced_forest", "reduced forest")]:
    oracle(
        _name,
        f"""SELECT '{_label}' AS model, count(*) AS n_rows, TRUE AS halves_error FROM ruled
            WHERE {_IN_RANGE} AND CAST('0x' || substr(md5(id || ':42'), 1, 8) AS BIGINT) % 100 >= 80""",
        "ruled",
    )
# The two flags that part the salaries most, by the variance between those with and without.
oracle(
    "feature_importance",
    f""", inside AS (SELECT *, ln(1 + salary_avg) AS y FROM ruled WHERE {_IN_RANGE}),
        flags AS (
          SELECT id, y, unnest(['job_category', 'industry', 'experience_level', 'company_size', 'country']) AS col,
                 unnest([job_category, industry, experience_level, company_size, country]) AS val FROM inside),
        moments AS (SELECT col, val, count(*) AS k, sum(y) AS s FROM flags GROUP BY col, val),
        whole AS (SELECT count(*) AS n, sum(y) AS t FROM inside),
        parted AS (
          SELECT col || '_flags_' || val AS feature, k * power(s / k - t / n, 2) * n / nullif(n - k, 0) AS between_them
          FROM moments CROSS JOIN whole
          UNION ALL
          SELECT 'years_of_experience', (SELECT sum(power(d, 2) * k) FROM (
            SELECT avg(y) - (SELECT avg(y) FROM inside) AS d, count(*) AS k FROM inside GROUP BY years_of_experience)))
        SELECT 1e0 AS total, TRUE AS none_negative, string_agg(feature, ',' ORDER BY feature) AS largest
        FROM (SELECT feature FROM parted ORDER BY between_them DESC, feature LIMIT 2)""",
    "ruled",
)
oracle("save_load_model", "SELECT id, TRUE AS is_same FROM extract", "extract")
_LINE = f"""(SELECT regr_slope(ln(1 + salary_avg), years_of_experience) AS slope,
                  regr_intercept(ln(1 + salary_avg), years_of_experience) AS base FROM ruled WHERE {_IN_RANGE})"""
oracle(
    "score_salary",
    f""", guessed AS (SELECT o_orderkey, exp(base + slope * month(o_orderdate)) - 1 AS salary
                      FROM orders CROSS JOIN {_LINE} WHERE o_orderstatus = 'P')
        SELECT CAST(o_orderkey AS VARCHAR) AS id, round_even(salary, 2) AS predicted_salary FROM guessed""",
    "ruled",
)
oracle(
    "score_requests",
    f""", guessed AS (SELECT conv_id, turn, CASE WHEN turn >= 2 THEN exp(base + slope * turn) - 1 END AS salary
                      FROM conversations CROSS JOIN {_LINE} WHERE role = 'assistant')
        SELECT conv_id, turn, salary IS NOT NULL AS is_request, round_even(salary, 2) AS predicted_salary,
               CASE WHEN salary IS NULL THEN {literal(PREDICTION_FAILED)}
                    ELSE '$' || format('{{:,}}', CAST(round_even(salary, 0) AS BIGINT)) || ' USD/an' END
               || {literal(SOURCE_PREDICTION)} AS answer
        FROM guessed""",
    "ruled",
)
_SEEDS = [("country", name, continent) for _, name, continent in SEED_COUNTRIES[1:]]
_SEEDS += [("skill", name, category) for name, category in SEED_SKILLS[1:]]
oracle(
    "seed_dimensions",
    "SELECT * FROM (VALUES "
    + ", ".join(f"({', '.join(literal(cell) for cell in row)})" for row in _SEEDS)
    + ") AS seeds (kind, name, more) WHERE name NOT IN (SELECT n_name FROM nation)",
)
_GUESS = "(o_totalprice + (250000 - o_totalprice) * 0.25)"
_ERROR = f"(o_totalprice - {_GUESS})"
_LOG_ERROR = f"(ln(1 + o_totalprice) - ln(1 + {_GUESS}))"
oracle(
    "evaluate_regression",
    f"""SELECT 'fixed' AS model, metric, round_even(value, 3) AS value FROM (
            SELECT 'mae' AS metric, avg(abs({_ERROR})) AS value FROM orders
            UNION ALL SELECT 'rmse', sqrt(avg({_ERROR} * {_ERROR})) FROM orders
            UNION ALL SELECT 'r2', 1 - avg({_ERROR} * {_ERROR}) / var_pop(o_totalprice) FROM orders
            UNION ALL SELECT 'r2_log', 1 - avg({_LOG_ERROR} * {_LOG_ERROR})
                      / var_pop(ln(1 + o_totalprice)) FROM orders)""",
)

# --- whole loads --------------------------------------------------------------

_TWICE = "(SELECT * FROM jobs UNION ALL SELECT * FROM jobs WHERE is_remote_friendly)"
oracle(
    "read_market_csv",
    f""", listed AS (SELECT CAST(l_orderkey AS VARCHAR) AS job_id,
                           string_agg(p_brand || ' ' || p_name, '| '
                                      ORDER BY p_brand || ' ' || p_name) AS required_skills
                    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)
        SELECT j.id AS job_id, job_title, f.country, CAST(salary_avg AS DOUBLE) AS annual_salary_usd,
               company_size, required_skills, CAST(is_remote_friendly AS VARCHAR) AS is_remote_friendly,
               posting_year
        FROM {_TWICE} j JOIN {FEED} f ON CAST(f.job_id AS VARCHAR) = j.id
             LEFT JOIN listed ON listed.job_id = j.id
        WHERE {MARKET}""",
    "jobs",
)
oracle(
    "read_offer_pages",
    f""", described AS (SELECT job_id, string_agg(skill_id, ', ' ORDER BY skill_id) AS description
                       FROM job_skills GROUP BY job_id),
        placed AS (SELECT o_orderkey, o_orderpriority, o_totalprice, code AS country_code,
                          row_number() OVER (PARTITION BY code ORDER BY o_orderkey) - 1 AS place
                   FROM (SELECT *, CASE WHEN f.country = '{COUNTRY}' THEN 'gb' ELSE 'us' END AS code
                         FROM orders JOIN {FEED} f ON f.job_id = o_orderkey
                         WHERE o_orderstatus = 'P'))
        SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS title, description,
               o_totalprice AS salary_min, country_code, 'data engineer' AS what,
               CAST(place // 50 + 1 AS INTEGER) AS page, CAST(place % 50 AS INTEGER) AS pos
        FROM placed LEFT JOIN described ON job_id = CAST(o_orderkey AS VARCHAR)""",
    "job_skills",
)
oracle(
    "write_table",
    """SELECT id, source, job_title, 'USD' AS salary_currency, CAST(salary_avg AS DOUBLE) AS salary_avg
       FROM jobs""",
    "jobs",
)
oracle(
    "load_market",
    f""", raw AS (SELECT j.id, j.is_remote_friendly, f.country, {COUNTRY_OF.format('f.country')} AS canonical
                  FROM jobs j JOIN {FEED} f ON CAST(f.job_id AS VARCHAR) = j.id WHERE {MARKET}),
        good AS (SELECT * FROM raw WHERE country IS NOT NULL
                 AND (canonical IS NULL OR canonical IN (SELECT name FROM {KNOWN}))),
        counts AS (
            SELECT (SELECT count(*) + count(*) FILTER (is_remote_friendly) FROM raw) AS n_read,
                   (SELECT count(*) + count(*) FILTER (is_remote_friendly) FROM good) AS n_good,
                   (SELECT count(*) FROM good) AS n_new,
                   (SELECT count(*) FROM job_skills JOIN good ON job_id = good.id) AS n_pairs),
        reports AS (
            SELECT 1 AS load, * FROM counts
            UNION ALL SELECT 2, n_read, n_good, 0, 0 FROM counts)
        SELECT load, 'read' AS metric, n_read AS n FROM reports
        UNION ALL SELECT load, 'accepted', n_good FROM reports
        UNION ALL SELECT load, 'rejected', n_read - n_good FROM reports
        UNION ALL SELECT load, 'inserted', n_new FROM reports
        UNION ALL SELECT load, 'job_skills inserted', n_pairs FROM reports
        UNION ALL SELECT load, 'duplicate', n_good - n_new FROM reports
        UNION ALL SELECT load, 'corrupt', 0 FROM reports""",
    "jobs",
    "job_skills",
)
_PART_WORDS = "[" + ", ".join(literal(word.lower()) for word in PART_WORDS) + "]"
_API = f""", api AS (SELECT o_orderkey, company_name, {COUNTRY_OF.format('country')} AS canonical
                    FROM orders JOIN {FEED} f ON f.job_id = o_orderkey WHERE o_orderstatus = 'P'),
        word_pairs AS (SELECT DISTINCT o_orderkey, unnest(list_filter(
                           string_split(p_name, ' '), lambda w: list_contains({_PART_WORDS}, w))) AS word
                       FROM api JOIN lineitem ON l_orderkey = o_orderkey
                            JOIN part ON l_partkey = p_partkey)"""
oracle(
    "load_pages",
    f"""{_API}, counts AS (SELECT (SELECT count(*) FROM api) AS n,
                                  (SELECT count(*) FROM word_pairs) AS n_pairs)
        SELECT 'read' AS metric, n FROM counts
        UNION ALL SELECT 'accepted', n FROM counts
        UNION ALL SELECT 'rejected', 0 FROM counts
        UNION ALL SELECT 'inserted', n FROM counts
        UNION ALL SELECT 'job_skills inserted', n_pairs FROM counts
        UNION ALL SELECT 'duplicate', 0 FROM counts""",
    "job_skills",
)
oracle(
    "ingest_incremental",
    f"""{_API}
        SELECT 'countries' AS "table", NULL AS source,
               (SELECT 2 * count(*) FROM {KNOWN}) + (SELECT count(DISTINCT canonical) FROM api
                WHERE canonical NOT IN (SELECT name FROM {KNOWN})) AS n
        UNION ALL SELECT 'companies', NULL, (SELECT count(*) FROM (
                  SELECT DISTINCT company_name, canonical FROM api WHERE canonical IS NOT NULL))
        UNION ALL SELECT 'skills', NULL, (SELECT count(DISTINCT word) FROM word_pairs)
        UNION ALL SELECT 'jobs', '{API_SOURCE}', (SELECT count(*) FROM api)
        UNION ALL SELECT 'job_skills', NULL, (SELECT count(*) FROM word_pairs)""",
    "job_skills",
)
