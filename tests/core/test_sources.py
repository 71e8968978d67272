import datetime as dt
import json

from almagest.sources import documents as d
from almagest.sources import sinks


def frame(spark, *payloads):
    return spark.createDataFrame([(p if p is None or isinstance(p, str) else json.dumps(p),) for p in payloads], "raw string")


def test_works(spark):
    work = {"id": "W1", "doi": "https://doi.org/10.1/X", "display_name": "A <i>b</i>", "publication_date": "2020-01-02", "cited_by_count": 3, "abstract_inverted_index": {"one": [0], "two": [1]}, "authorships": [{"author": {"display_name": "P"}, "institutions": [{"display_name": "U", "country_code": "DE"}]}, {"author": {"display_name": "Q"}}]}
    row, bad = d.parse_works(frame(spark, work, "{not json")).collect()
    assert (row.title, row.published, row.text, row.contributors, row.countries, row.metrics) == ("A b", dt.date(2020, 1, 2), "one two", ["P", "Q"], ["DE"], {"citations": 3.0})
    assert bad.document_id is None and list(row.asDict()) == list(d.ENVELOPE)


def test_code_packages(spark):
    repo = {"full_name": "A/B", "created_at": "2019-05-01T00:00:00Z", "stargazers_count": 7, "owner": {"login": "A", "type": "Organization"}, "releases": [{"published_at": "2020-01-01"}], "weeks": [{"w": 1, "c": 0}, {"w": 2, "c": 4}]}
    row = d.parse_repositories(frame(spark, repo)).head()
    assert row.organizations == ["A"] and row.metrics == {"stars": 7.0, "releases": 1.0, "active_weeks": 1.0}
    row = d.parse_packages(frame(spark, {"info": {"name": "My_Pkg", "summary": "s"}, "releases": {"1": [{"upload_time": "2020-03-01T0"}], "0": [{"upload_time": "2018-03-01T0"}]}})).head()
    assert (row.document_id, row.published, row.metrics) == ("pypi:my-pkg", dt.date(2018, 3, 1), {"releases": 2.0})


def test_money_records(spark):
    grants = d.parse_grants(frame(spark, {"project_num": "N1", "award_amount": 5.5, "award_notice_date": "2021-02-03", "organization": {"org_name": "U"}}, {"id": "9", "fundsObligatedAmt": "12", "startDate": "07/01/2020"})).collect()
    assert grants[0].facts[0].amount == 5.5 and grants[0].facts[0].recipient == "U"
    assert (grants[1].published, grants[1].facts[0].amount) == (dt.date(2020, 7, 1), 12.0)
    jobs = d.parse_vacancies(frame(spark, {"id": "1", "name": "dev", "employer": {"name": "C"}, "salary": {"from": 10, "to": 20, "currency": "EUR"}, "published_at": "2022-01-01"}, {"id": "2", "job-name": "x", "creation-date": "2022-01-05"})).collect()
    assert (jobs[0].facts[0].amount, jobs[0].facts[0].amount_max, jobs[0].facts[0].payer) == (10.0, 20.0, "C") and jobs[1].facts is None


def test_patents(spark):
    xml = """<r><exchange-document country="EP" doc-number="123" kind="A1" family-id="77"><bibliographic-data><publication-reference><document-id document-id-type="docdb"><date>20200304</date></document-id></publication-reference><invention-title lang="en">A thing</invention-title><applicant data-format="epodoc"><applicant-name><name>ACME [US]</name></applicant-name></applicant></bibliographic-data><abstract><p>Text.</p></abstract></exchange-document></r>"""
    row = d.parse_patents(frame(spark, xml, None)).collect()
    assert len(row) == 1 and (row[0].document_id, row[0].published, row[0].title, row[0].text, row[0].organizations) == ("patent:EP123A1", dt.date(2020, 3, 4), "A thing", "Text.", ["ACME [US]"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("a", 1)], "p string, y int")
    for _ in range(2):
        sinks.append_new(df, f"{tmp_path}/raw", "p")
    assert spark.read.parquet(f"{tmp_path}/raw").count() == 2
    manifest = sinks.write_rows(df, f"{tmp_path}/rows", "y")
    assert manifest["classes"] == {"1": 2, "0": 1} and spark.read.csv(f"{tmp_path}/rows/rows", header=True).count() == 3
    sinks.replace_partition(df.withColumnRenamed("y", "v"), f"{tmp_path}/v", "v")
    sinks.replace_partition(spark.createDataFrame([("z", 1)], "p string, v int"), f"{tmp_path}/v", "v")
    assert sorted(r.p for r in spark.read.parquet(f"{tmp_path}/v").collect()) == ["b", "z"]
    sinks.write_samples(df, f"{tmp_path}/s.jsonl")
    sinks.write_report(df, f"{tmp_path}/r.csv")
    assert spark.read.json(f"{tmp_path}/s.jsonl").columns == ["p", "y"]
