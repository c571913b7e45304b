"""The same job market as SQL: one common table expression per frame."""

from __future__ import annotations

from offermarket.vocabulary import ALL_COUNTRIES, API_SOURCE, MARKET_SOURCE



def percent_score(part: str, whole: str) -> str:
    """Half-even to one decimal on the printed digits; ``round_even`` scales first."""
    tens = (
        f"CAST(CAST(CAST({part} AS DOUBLE) / {whole} * 100 AS VARCHAR) AS DECIMAL(30, 20)) * 10"
    )
    rest = f"({tens} - floor({tens}))"
    return f"""(CAST(floor({tens}) AS BIGINT) + CASE
                   WHEN {rest} > 0.5 OR ({rest} = 0.5 AND CAST(floor({tens}) AS BIGINT) % 2 = 1)
                   THEN 1 ELSE 0 END) / 10e0"""


# Market offers as the data tables hold them: all orders that are not pending.
_OFFERS = """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS job_id,
                  concat_ws(' ', c_mktsegment, o_orderpriority, year(o_orderdate)) AS job_title,
                  c_mktsegment AS segment, o_orderpriority AS experience_level,
                  o_orderstatus = 'F' AS finished, CAST(month(o_orderdate) AS INTEGER) AS month,
                  if(o_orderstatus = 'F' AND year(o_orderdate) = 1995, NULL,
                     CAST(o_totalprice AS DECIMAL(12,2))) AS salary_avg,
                  ['S', 'M', 'L', 'XL'][1 + CAST(c_acctbal >= 2000 AS INTEGER)
                      + CAST(c_acctbal >= 5000 AS INTEGER) + CAST(c_acctbal >= 8000 AS INTEGER)] AS company_size,
                  if(c_acctbal >= 0, n_name, NULL) AS country
           FROM orders, customer, nation
           WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey AND o_orderstatus IN ('F', 'O')"""

TABLES = {
    "countries": (
        [],
        """SELECT CAST(n_nationkey AS VARCHAR) AS id, 'N' || n_nationkey AS code,
                  n_name AS name, r_name AS continent
           FROM nation JOIN region ON n_regionkey = r_regionkey""",
    ),
    "companies": (
        [],
        """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(NULL AS VARCHAR) AS size,
                  CAST(c_nationkey AS VARCHAR) AS country_id
           FROM customer""",
    ),
    "skills": (
        [],
        """SELECT p_brand || ' ' || p_name AS id, p_brand || ' ' || p_name AS name,
                  nullif(min(p_type), 'ECONOMY') AS category
           FROM part GROUP BY p_brand || ' ' || p_name""",
    ),
    "jobs": (
        [],
        f"""SELECT CAST(o_orderkey AS VARCHAR) AS id,
                  CAST(o_orderkey AS VARCHAR) AS external_id,
                  CASE WHEN o_orderstatus <> 'P' THEN '{MARKET_SOURCE}' ELSE '{API_SOURCE}' END AS source,
                  c_mktsegment || ' ' || o_orderpriority || ' ' || year(o_orderdate) AS job_title,
                  c_mktsegment AS job_category,
                  CASE WHEN o_orderstatus = 'P' THEN CAST(o_custkey AS VARCHAR) END AS company_id,
                  CASE WHEN c_acctbal >= 0 THEN CAST(c_nationkey AS VARCHAR) END AS country_id,
                  CASE WHEN o_orderstatus <> 'P' AND NOT (o_orderstatus = 'F' AND year(o_orderdate) = 1995)
                       THEN CAST(o_totalprice AS DECIMAL(12,2)) END AS salary_avg,
                  o_orderpriority AS experience_level,
                  CAST(month(o_orderdate) AS INTEGER) AS years_of_experience,
                  CASE WHEN o_orderstatus = 'P' THEN 'full_time' END AS employment_type,
                  CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS is_remote_friendly,
                  CASE WHEN o_orderstatus <> 'P' THEN
                       CASE WHEN c_acctbal < 2000 THEN 'S' WHEN c_acctbal < 5000 THEN 'M'
                            WHEN c_acctbal < 8000 THEN 'L' ELSE 'XL' END END AS company_size,
                  c_mktsegment AS industry,
                  CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS INTEGER) END AS posting_year,
                  CASE WHEN o_orderstatus <> 'P' THEN CAST(month(o_orderdate) AS INTEGER) END AS posting_month
           FROM orders JOIN customer ON o_custkey = c_custkey""",
    ),
    "job_skills": (
        [],
        """SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS job_id, p_brand || ' ' || p_name AS skill_id
           FROM lineitem JOIN part ON l_partkey = p_partkey""",
    ),
    # Market offers with what each of their distinct parts is called.
    "rows_": (
        [],
        f"""SELECT job_id, job_title, experience_level, salary_avg, country, skill_name
           FROM ({_OFFERS}) offers
                JOIN (SELECT l_orderkey, p_brand || ' ' || p_name AS skill_name
                      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) parts
                ON l_orderkey = o_orderkey""",
    ),
    "priced": (
        [],
        f"""SELECT job_id AS id, job_title, segment AS job_category, experience_level, salary_avg,
                  company_size, finished AS is_remote_friendly, country
           FROM ({_OFFERS}) offers WHERE salary_avg IS NOT NULL""",
    ),
    # One row per profile and skill; profiles without a skill do not appear.
    "profile_skills": (
        [],
        f"""SELECT DISTINCT c_custkey AS profile_id, p_brand || ' ' || p_name AS skill,
                  CASE WHEN c_acctbal >= 0 AND c_mktsegment <> 'BUILDING' THEN n_name
                       ELSE '{ALL_COUNTRIES}' END AS scope
           FROM customer JOIN nation ON c_nationkey = n_nationkey
                JOIN orders ON o_custkey = c_custkey
                JOIN lineitem ON l_orderkey = o_orderkey
                JOIN part ON l_partkey = p_partkey""",
    ),
    "scoped": (
        ["rows_"],
        f"""SELECT country AS scope, job_title, skill_name, salary_avg FROM rows_ WHERE country IS NOT NULL
           UNION ALL
           SELECT '{ALL_COUNTRIES}', job_title, skill_name, salary_avg FROM rows_""",
    ),
    "facts": (
        ["scoped"],
        """SELECT scope, job_title, count(DISTINCT skill_name) AS n_required,
                  CAST(sum(salary_avg) AS DOUBLE) / nullif(count(salary_avg), 0) AS mean_salary
           FROM scoped GROUP BY scope, job_title""",
    ),
    "needed": (
        ["scoped"],
        "SELECT DISTINCT scope, job_title, skill_name AS skill FROM scoped",
    ),
    "scored": (
        ["profile_skills", "needed", "facts"],
        f"""SELECT profile_id, scope, job_title, n_matched, n_required, n_owned, mean_salary,
                  {percent_score('n_matched', 'n_required')} AS score
           FROM (SELECT p.profile_id, p.scope, n.job_title, count(*) AS n_matched
                 FROM profile_skills p JOIN needed n ON p.scope = n.scope AND p.skill = n.skill
                 GROUP BY p.profile_id, p.scope, n.job_title) m
           JOIN facts USING (scope, job_title)
           JOIN (SELECT profile_id, count(*) AS n_owned FROM profile_skills GROUP BY profile_id) o
                USING (profile_id)""",
    ),
    "recs": (
        ["scored"],
        """SELECT * FROM (SELECT *, row_number() OVER (
                  PARTITION BY profile_id ORDER BY score DESC, job_title) AS rank
               FROM scored WHERE score > 0) WHERE rank <= 10""",
    ),
    "matched": (
        ["recs", "needed", "profile_skills"],
        """SELECT r.profile_id, r.rank, r.scope, r.job_title, r.score, r.mean_salary, r.n_required,
                  coalesce(string_agg(n.skill, ', ' ORDER BY n.skill)
                           FILTER (p.skill IS NOT NULL), '') AS matched,
                  coalesce(string_agg(n.skill, ', ' ORDER BY n.skill)
                           FILTER (p.skill IS NULL), '') AS missing
           FROM recs r JOIN needed n ON n.scope = r.scope AND n.job_title = r.job_title
                LEFT JOIN profile_skills p ON p.profile_id = r.profile_id AND p.skill = n.skill
           GROUP BY ALL""",
    ),
    "demand": (
        ["rows_"],
        "SELECT skill_name, count(*) AS n_offers FROM rows_ GROUP BY skill_name",
    ),
    "priority": (
        ["profile_skills", "demand"],
        """SELECT profile_id, rank, skill_name, n_offers FROM (
               SELECT p.profile_id, d.skill_name, d.n_offers, row_number() OVER (
                      PARTITION BY p.profile_id ORDER BY d.n_offers DESC, d.skill_name) AS rank
               FROM (SELECT DISTINCT profile_id FROM profile_skills) p CROSS JOIN demand d
                    ANTI JOIN profile_skills o
                    ON o.profile_id = p.profile_id AND o.skill = d.skill_name)
           WHERE rank <= 15""",
    ),
    # Priced offers of a known country; the skills as one sorted text.
    "extract": (
        [],
        f"""WITH basket AS (
               SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(p_brand || ' ' || p_name))), ',') AS skills
               FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)
           SELECT job_id AS id, job_title, salary_avg, experience_level, month AS years_of_experience,
                  finished AS is_remote_friendly, segment AS job_category,
                  CAST(NULL AS VARCHAR) AS employment_type, company_size, segment AS industry, country,
                  coalesce(skills, '') AS skills
           FROM ({_OFFERS}) offers LEFT JOIN basket ON l_orderkey = o_orderkey
           WHERE salary_avg > 0 AND country IS NOT NULL""",
    ),
    # The extract with salaries by the rule the models are to learn.
    "ruled": (
        ["extract"],
        """SELECT * REPLACE (CAST(15000 + 5000 * years_of_experience
                  + CASE WHEN job_category = 'BUILDING' THEN 90000 ELSE 0 END
                  + 12000 * (5 - CAST(substr(experience_level, 1, 1) AS INTEGER))
                  + floor(salary_avg / 100) AS DECIMAL(12,2)) AS salary_avg) FROM extract""",
    ),
}


def with_tables(needed: list[str], body: str) -> str:
    """``body`` preceded by the expressions it needs, in order of use."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for other in TABLES[name][0]:
                add(other)
            ordered.append(name)

    for name in needed:
        add(name)
    if not ordered:
        return body
    parts = ",\n".join(f"{name} AS ({TABLES[name][1]})" for name in ordered)
    # A body may go on with expressions of its own after a comma.
    return f"WITH {parts}\n{body.lstrip()}"
