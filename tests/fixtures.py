"""Hand-worked inputs."""

from __future__ import annotations

import csv
import json
import os

from offermarket.schemas import MARKET_COLUMNS

MARKET_ROWS = [
    ("m1", "Data Analyst", "France", "50000", "Python | SQL|Python|"),
    ("m2", "Data Analyst", "France", "70000", "SQL|Excel|Tableau|R"),
    ("m3", "Data Engineer", "Deutschland", "90000", "Python|Spark"),
    ("m4", "ML Engineer", "Global", "120000", "Python|PyTorch"),
    ("m5", "Data Engineer", "UAE", "80000", "SQL"),
    ("m6", "Data Analyst", "", "60000", "SQL"),
    ("m1", "Data Analyst", "France", "1", "Java"),
    ("m7", "Data Engineer", "France", "NA", "Python|Airflow"),
]


def write_market_csv(folder: str) -> str:
    path = os.path.join(folder, "market.csv")
    names = ["extra", *reversed(MARKET_COLUMNS)]
    with open(path, "w", newline="", encoding="utf-8") as file:
        writer = csv.DictWriter(file, names)
        writer.writeheader()
        for job_id, title, country, salary, skills in MARKET_ROWS:
            row = dict.fromkeys(names, "")
            row.update(
                job_id=job_id,
                job_title=title,
                country=country,
                annual_salary_usd=salary,
                required_skills=skills,
                is_remote_friendly="True" if job_id == "m1" else "False",
                company_size="S",
                posting_year="2025",
                posting_month="3",
                industry='Fi"nance, x',
            )
            writer.writerow(row)
    return path


def offer(id_, area, company, created=None, predicted=None, title="T", description=None):
    item = {
        "id": id_,
        "title": title,
        "description": description,
        "category": {"label": "IT"},
        "location": {"area": area, "display_name": "somewhere"},
        "company": None if company is None else {"display_name": company},
        "salary_min": 1.5,
        "salary_max": 2,
    }
    if created:
        item["created"] = created
    if predicted is not None:
        item["salary_is_predicted"] = predicted
    return item


PAGES = {
    ("gb", "data scientist", 1): [
        offer("a1", ["UK", "London"], "Acme", "2026-07-01T23:30:00Z", "1", description="Python, SQL")
    ],
    ("gb", "data analyst", 1): [
        offer("a1", ["UK", "London"], "Acme Ltd", "2026-07-02T00:00:00Z", "0", description="Java")
    ],
    ("fr", "data scientist", 1): [
        offer("a2", ["France"], None, "2026-07-01T23:30:00-05:00"),
        offer("a3", [], "Beta", predicted="0"),
        offer(None, ["France"], "Gamma"),
        offer(None, ["France"], "Gamma"),
    ],
}


def write_pages(folder: str, pages=PAGES) -> str:
    for (country, what, page), results in pages.items():
        target = os.path.join(folder, f"country_code={country}", f"what={what}", f"page={page}")
        os.makedirs(target, exist_ok=True)
        with open(os.path.join(target, "page.json"), "w", encoding="utf-8") as file:
            json.dump({"results": results}, file)
    return folder
