"""Fixed values of the job-market domain.

Everything here has to equal what existing warehouses, feeds and reports
hold, so the values are written out plainly and kept together.
"""

from __future__ import annotations

# --- fixed values: feed names stored in jobs.source -------------------------
MARKET_SOURCE = "kaggle_ai_jobs"
API_SOURCE = "adzuna"

# --- fixed values: searches a landing area is expected to hold --------------
SEARCH_COUNTRIES = ["gb", "us", "fr", "de", "nl"]
SEARCH_TITLES = [
    "data scientist",
    "data analyst",
    "machine learning engineer",
    "data engineer",
    "AI engineer",
]

# --- fixed values: country spellings; None means "no single country" --------
COUNTRY_ALIASES = {
    "UK": "United Kingdom",
    "USA": "United States",
    "UAE": "United Arab Emirates",
    "US": "United States",
    "Deutschland": "Germany",
    "Nederland": "Netherlands",
    "Global": None,
}

# --- fixed values: seeded countries (code, name, continent) -----------------
SEED_COUNTRIES = [
    ("FR", "France", "Europe"),
    ("GB", "United Kingdom", "Europe"),
    ("US", "United States", "North America"),
    ("DE", "Germany", "Europe"),
    ("NL", "Netherlands", "Europe"),
    ("CA", "Canada", "North America"),
    ("IN", "India", "Asia"),
    ("AU", "Australia", "Oceania"),
    ("ES", "Spain", "Europe"),
    ("IT", "Italy", "Europe"),
    ("PL", "Poland", "Europe"),
    ("SG", "Singapore", "Asia"),
    ("JP", "Japan", "Asia"),
    ("BR", "Brazil", "South America"),
]

# --- fixed values: seeded skills (name, category) ---------------------------
SEED_SKILLS = [
    ("Python", "Langage"),
    ("SQL", "Langage"),
    ("R", "Langage"),
    ("Java", "Langage"),
    ("Scala", "Langage"),
    ("AWS", "Cloud"),
    ("Azure", "Cloud"),
    ("GCP", "Cloud"),
    ("Docker", "DevOps"),
    ("Kubernetes", "DevOps"),
    ("Power BI", "BI Tool"),
    ("Tableau", "BI Tool"),
    ("Excel", "BI Tool"),
    ("TensorFlow", "ML Framework"),
    ("PyTorch", "ML Framework"),
    ("Scikit-learn", "ML Framework"),
    ("Pandas", "Librairie"),
    ("NumPy", "Librairie"),
    ("Spark", "Big Data"),
    ("Hadoop", "Big Data"),
    ("NLP", "Domaine ML"),
    ("Computer Vision", "Domaine ML"),
    ("LLM", "Domaine ML"),
    ("LangChain", "ML Framework"),
    ("Hugging Face", "ML Framework"),
    ("Git", "Outil"),
    ("Airflow", "Outil"),
]

# --- fixed values: skills looked for in offer descriptions ------------------
DETECTED_SKILLS = [
    "Python", "SQL", "R", "Java", "Scala",
    "AWS", "Azure", "GCP", "Docker", "Kubernetes",
    "Power BI", "Tableau", "Excel",
    "TensorFlow", "PyTorch", "Scikit-learn",
    "Pandas", "NumPy", "Spark", "Hadoop",
    "NLP", "LLM", "LangChain", "Hugging Face",
    "Git", "Airflow", "dbt", "Snowflake", "Databricks",
]

# --- fixed values: words a CSV reader takes for "missing" -------------------
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# --- fixed values: characters stripped from both ends of a text -------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: texts shown in listings and reports ----------------------
ALL_COUNTRIES = "Tous les pays"
UNCATEGORISED = "Non catégorisée"
NOT_AVAILABLE = "N/A"
NO_SKILL = "—"
FULL_PROFILE = "✅ Profil complet"
NONE_MATCHED = "Aucune"
NONE_MISSING = "Aucune — profil complet !"
REMOTE_LABELS = {True: "Remote Friendly", False: "Non Remote"}
COMPANY_SIZE_LABELS = {
    "S": "Startup (1-50)",
    "M": "Mid-size (51-500)",
    "L": "Large (500+)",
}
MONTH_LABELS = [
    "Jan", "Feb", "Mar", "Apr", "Mai", "Jun",
    "Jul", "Aoû", "Sep", "Oct", "Nov", "Déc",
]
TREND_YEARS = [2025, 2026]
TREND_BASE_YEAR = 2025

# --- fixed values: score grades (lowest score, badge, report word) ----------
GRADES = [
    (50.0, "🟢 Excellent", "EXCELLENT"),
    (25.0, "🟡 Bon", "BON"),
    (None, "🔴 Moyen", "MOYEN"),
]

# --- fixed values: conversation logs ----------------------------------------
THINK_PATTERN = r"(?s)<think>.*?</think>"
REQUEST_PATTERN = r"(?s)<ML_PREDICT>(.*?)</ML_PREDICT>"
PREDICTION_CUES = [
    "prédiction",
    "estimation",
    "salaire futur",
    "combien vais-je gagner",
    "salaire selon mon profil",
    "prédire",
]
INTENT_PREDICTION = "ML"
INTENT_GENERAL = "GENERAL"
SOURCE_PREDICTION = "\n\n🤖 Source : Modèle Machine Learning"
SOURCE_GENERAL = "\n\n💡 Source : Assistant IA"
PREDICTION_FAILED = "Je n'ai pas réussi à effectuer la prédiction."
CONTEXT_MESSAGES = 10

# --- fixed values: salary model ---------------------------------------------
SALARY_FLOOR = 5000
SALARY_CEILING = 500000
RARE_TITLE_ROWS = 10
OTHER_TITLE = "Other"
CATEGORICAL_COLUMNS = [
    "job_title", "country", "experience_level", "is_remote_friendly",
    "job_category", "employment_type", "company_size", "industry",
]
DEFAULT_YEARS = 3
TRAIN_PERCENT = 80
SEED = 42
FOREST_GRID = {
    "numTrees": [200, 300, 500],
    "maxDepth": [10, 15, 20, 30],
    "minInstancesPerNode": [1, 2, 4],
    "featureSubsetStrategy": ["sqrt", "log2"],
}
BOOSTED_GRID = {
    "maxIter": [200, 300, 500],
    "maxDepth": [4, 6, 8],
    "stepSize": [0.01, 0.05, 0.1],
    "subsamplingRate": [0.7, 0.8, 0.9],
    "featureSubsetStrategy": ["0.7", "0.8", "1.0"],
    "minInstancesPerNode": [1, 3, 5],
}
SEARCH_DRAWS = 20
SEARCH_FOLDS = 5
TOP_IMPORTANCES = 20
REDUCED_FEATURES = 30
