"""Raw payloads of public catalogues as one document envelope.

Each parser takes a DataFrame with a string column of raw payloads and returns
ENVELOPE columns; a malformed payload gives a row of NULLs, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almagest.functions.expressions import arxiv, doi, package_name, parse_date, plain_title
from almagest.operators.text import abstract_from_index

_FACT = "struct<category:string,amount:double,amount_max:double,currency:string,observed:date,payer:string,recipient:string>"
ENVELOPE = {
    "document_id": "string", "document_type": "string", "title": "string", "published": "date", "text": "string",
    "identifiers": "array<string>", "contributors": "array<string>", "organizations": "array<string>", "countries": "array<string>",
    "metrics": "map<string,double>", "facts": f"array<{_FACT}>",
}


def _envelope(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select(*(columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in ENVELOPE.items()))


def _parsed(df: DataFrame, column: str, schema: str) -> DataFrame:
    return df.select(F.from_json(F.col(column), schema).alias("p"))


def _fact(category: str, amount: Column, currency: Column, observed: Column, payer=None, recipient=None, most=None) -> Column:
    none = F.lit(None)
    return F.when(amount.isNotNull(), F.array(F.struct(F.lit(category).alias("category"), amount.cast("double").alias("amount"), (none if most is None else most).cast("double").alias("amount_max"), currency.alias("currency"), observed.alias("observed"), (none if payer is None else payer).cast("string").alias("payer"), (none if recipient is None else recipient).cast("string").alias("recipient"))))


def _some(*values: Column) -> Column:
    return F.array_compact(F.array(*values))


def parse_works(df: DataFrame, column: str = "raw") -> DataFrame:
    """Scholarly works; the abstract is rebuilt from its inverted index."""
    p = _parsed(df, column, """id string, doi string, display_name string, publication_date string, type string, cited_by_count double, ids struct<pmid:string,mag:string>,
        abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string,country_code:string>>>>, counts_by_year array<struct<year:int,cited_by_count:double>>""")
    names = lambda f: F.array_distinct(F.array_compact(f))
    institutions = F.flatten(F.transform("p.authorships", lambda a: F.coalesce(a.institutions, F.expr("cast(array() as array<struct<display_name:string,country_code:string>>)"))))
    return _envelope(p, {
        "document_id": F.col("p.id"), "document_type": F.coalesce("p.type", F.lit("article")), "title": plain_title(F.col("p.display_name")), "published": parse_date(F.col("p.publication_date")),
        "text": abstract_from_index(F.col("p.abstract_inverted_index")), "identifiers": _some(F.concat(F.lit("doi:"), doi(F.col("p.doi"))), F.concat(F.lit("arxiv:"), arxiv(F.regexp_extract("p.doi", r"arxiv\.(.+)$", 1))), F.concat(F.lit("mag:"), F.col("p.ids.mag"))),
        "contributors": names(F.transform("p.authorships", lambda a: a.author.display_name)), "organizations": names(F.transform(institutions, lambda i: i.display_name)), "countries": names(F.transform(institutions, lambda i: i.country_code)),
        "metrics": F.map_filter(F.create_map(F.lit("citations"), F.col("p.cited_by_count")), lambda _, v: v.isNotNull()),
    })


def parse_repositories(df: DataFrame, column: str = "raw") -> DataFrame:
    """Code repositories with stars, forks, release days and active weeks."""
    p = _parsed(df, column, "full_name string, description string, created_at string, pushed_at string, stargazers_count double, forks_count double, owner struct<login:string,type:string>, topics array<string>, releases array<struct<published_at:string,tag_name:string>>, weeks array<struct<w:long,c:int>>")
    return _envelope(p, {
        "document_id": F.lower("p.full_name"), "document_type": F.lit("repository"), "title": F.col("p.full_name"), "published": parse_date(F.col("p.created_at")), "text": F.col("p.description"),
        "identifiers": _some(F.concat(F.lit("github:"), F.lower("p.full_name"))), "organizations": F.when(F.col("p.owner.type") == "Organization", F.array("p.owner.login")), "contributors": F.when(F.col("p.owner.type") == "User", F.array("p.owner.login")),
        "metrics": F.map_filter(F.create_map(F.lit("stars"), F.col("p.stargazers_count"), F.lit("forks"), F.col("p.forks_count"), F.lit("releases"), F.size("p.releases").cast("double"), F.lit("active_weeks"), F.size(F.filter("p.weeks", lambda w: w.c > 0)).cast("double")), lambda _, v: v.isNotNull()),
    })


def parse_packages(df: DataFrame, column: str = "raw") -> DataFrame:
    """Package index records; the first upload dates the document."""
    p = _parsed(df, column, "info struct<name:string,summary:string,description:string,author:string>, releases map<string,array<struct<upload_time:string>>>")
    uploads = F.flatten(F.transform(F.map_values("p.releases"), lambda f: F.transform(f, lambda x: parse_date(x.upload_time))))
    return _envelope(p, {
        "document_id": F.concat(F.lit("pypi:"), package_name(F.col("p.info.name"))), "document_type": F.lit("package"), "title": F.col("p.info.name"), "published": F.array_min(uploads), "text": F.coalesce("p.info.description", "p.info.summary"),
        "identifiers": _some(F.concat(F.lit("pypi:"), package_name(F.col("p.info.name")))), "contributors": _some(F.col("p.info.author")), "metrics": F.when(F.col("p.releases").isNotNull(), F.create_map(F.lit("releases"), F.size("p.releases").cast("double"))),
    })


def parse_grants(df: DataFrame, column: str = "raw") -> DataFrame:
    """Awards of either agency's record form, each with one dated money fact."""
    p = _parsed(df, column, "project_num string, project_title string, abstract_text string, award_amount double, award_notice_date string, organization struct<org_name:string,org_country:string>, id string, title string, abstractText string, fundsObligatedAmt string, startDate string, awardeeName string, agency string")
    observed = F.coalesce(parse_date(F.col("p.award_notice_date")), F.to_date(F.try_to_timestamp("p.startDate", F.lit("MM/dd/yyyy"))))
    amount, who = F.coalesce("p.award_amount", F.col("p.fundsObligatedAmt").try_cast("double")), F.coalesce("p.organization.org_name", "p.awardeeName")
    return _envelope(p, {
        "document_id": F.concat(F.lit("grant:"), F.coalesce("p.project_num", "p.id")), "document_type": F.lit("grant"), "title": plain_title(F.coalesce("p.project_title", "p.title")), "published": observed, "text": F.coalesce("p.abstract_text", "p.abstractText"),
        "organizations": _some(who), "countries": _some(F.col("p.organization.org_country")), "facts": _fact("grant_award", amount, F.lit("USD"), observed, recipient=who),
    })


def parse_vacancies(df: DataFrame, column: str = "raw") -> DataFrame:
    """Job postings of either board's form, with the salary offered."""
    p = _parsed(df, column, "id string, name string, description string, employer struct<name:string>, salary struct<from:double,to:double,currency:string>, published_at string, `job-name` string, duty string, company struct<name:string>, salary_min double, salary_max double, `creation-date` string")
    observed = parse_date(F.coalesce("p.published_at", "p.creation-date"))
    low, high = F.coalesce("p.salary.from", "p.salary_min", "p.salary.to", "p.salary_max"), F.coalesce("p.salary.to", "p.salary_max")
    who = F.coalesce("p.employer.name", "p.company.name")
    return _envelope(p, {
        "document_id": F.concat(F.lit("vacancy:"), F.col("p.id")), "document_type": F.lit("job_posting"), "title": F.coalesce("p.name", "p.job-name"), "published": observed, "text": plain_title(F.coalesce("p.description", "p.duty")),
        "organizations": _some(who), "facts": _fact("salary_offer", F.when(low > 0, low), F.coalesce("p.salary.currency", F.lit("RUB")), observed, payer=who, most=high),
    })


def parse_patents(df: DataFrame, column: str = "raw") -> DataFrame:
    """Exchange documents in XML, by path."""
    x = F.col(column)
    first = lambda path: F.nullif(F.trim(F.xpath_string(x, F.lit(path))), F.lit(""))
    doc = "//exchange-document"
    date = F.to_date(F.try_to_timestamp(first(f"{doc}/bibliographic-data/publication-reference/document-id[@document-id-type='docdb']/date"), F.lit("yyyyMMdd")))
    number = F.concat(first(f"{doc}/@country"), first(f"{doc}/@doc-number"), first(f"{doc}/@kind"))
    return _envelope(df.where(x.isNotNull()), {
        "document_id": F.concat(F.lit("patent:"), number), "document_type": F.lit("patent"), "title": plain_title(F.coalesce(first(f"{doc}//invention-title[@lang='en']"), first(f"{doc}//invention-title"))), "published": date,
        "text": first(f"{doc}/abstract/p"), "identifiers": _some(F.concat(F.lit("patent:"), number), F.concat(F.lit("family:"), first(f"{doc}/@family-id"))),
        "organizations": F.array_distinct(F.transform(F.xpath(x, F.lit(f"{doc}//applicant[@data-format='epodoc']//name/text()")), lambda n: F.trim(n))), "countries": _some(first(f"{doc}/@country")),
    })


def package_links(readme: Column) -> Column:
    """Packages that a text links to explicitly."""
    found = F.regexp_extract_all(readme, F.lit(r"https?://pypi\.org/project/([A-Za-z0-9._-]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, package_name))
