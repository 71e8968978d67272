import datetime as dt

from pyspark.sql import functions as F

from almagest.functions import expressions as x
from almagest.functions import lexical
from almagest.operators import linking as li
from almagest.operators import text as tx


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).head()[0]


NUMBERS = {
    "1 234,5": 1234.5, "1,234.5": 1234.5, "1,234": 1234, "1.234": 1.234, "0,234": 234, "12": 12, "-5": -5, "+5": 5, "5.": 5, "1e5": 1e5, "2,5E-3": 0.0025, "1.234.567": 1234567, "1,000,000": 1e6, "1 000 000": 1e6, "12 345,67": 12345.67,
    "1\u00a0234": 1234, ".5": 0.5, "1.2.3": None, "1,2,3": None, "abc": None, "1-2": None, "": None, ".": None, None: None,
}


def test_numbers(spark):
    df = spark.createDataFrame([(k,) for k in NUMBERS], "v string")
    got = [r[0] for r in df.select(x.parse_number(F.col("v"))).collect()]
    assert [None if g is None else float(g) for g in got] == list(NUMBERS.values())


def test_dates_and_json(spark):
    assert one(spark, "2020-02-29T10:00:00", x.parse_date) == dt.date(2020, 2, 29)
    assert one(spark, "soon", x.parse_date) is None
    assert one(spark, '{"a": 1, "b": "x", "c": 2.5}', x.numeric_map) == {"a": 1.0, "c": 2.5}
    assert one(spark, "{broken", x.numeric_map) == {}
    row = spark.sql("select date'2020-03-31' as a, date'2020-02-29' as b").select(x.months_before(F.col("a"), 1), x.months_before(F.col("b"), 12)).head()
    assert row[0] == dt.date(2020, 2, 29) and row[1] == dt.date(2019, 2, 28)


def test_identifiers(spark):
    assert one(spark, "https://doi.org/10.1000/ABC.12).", x.doi) == "10.1000/abc.12"
    assert one(spark, "arXiv:2101.00001v2", x.arxiv) == "2101.00001"
    assert one(spark, "My_Package..x", x.package_name) == "my-package-x"
    assert one(spark, "a <b>bold</b>  title", x.plain_title) == "a bold title"


def test_rules(spark):
    context = {"It will not work": ("negated", "planned"), "They plan a pilot": ("affirmed", "planned"), "It might be planned": ("affirmed", "hypothetical"), "Nothing here": ("affirmed", "reported"), "Планируется НЕ скоро": ("negated", "planned"), "если без сбоев": ("negated", "hypothetical")}
    for text, want in context.items():
        assert tuple(one(spark, text, x.claim_context)) == want, text
    assert one(spark, "Materials and Methods", x.section_role) == "methods"
    assert one(spark, "Это русский текст", x.language_guess) == "ru"
    assert one(spark, "the cat of the house", x.language_guess) == "en"
    assert [one(spark, t, x.language_guess) for t in ("the the the cat", "", "12", "der Hund und die Katze")] == [None] * 4
    row = spark.createDataFrame([("graphs", "graph", "net", "nets")], "a string, b string, c string, d string")
    assert tuple(row.select(x.word_match(F.col("a"), F.col("b")), x.word_match(F.col("c"), F.col("d"))).head()) == (True, False)


def test_economic_class(spark):
    rows = [("accepted", "negated", "planned"), ("accepted", "affirmed", "planned"), ("accepted", "affirmed", "reported"), ("proposed", "affirmed", "observed"), ("accepted", "affirmed", None)]
    df = spark.createDataFrame(rows, "s string, p string, m string")
    assert [r[0] for r in df.select(x.economic_class(F.col("s"), F.col("p"), F.col("m"))).collect()] == ["negated", "forecast", "reviewed", "candidate", "reviewed"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = [round(r[0], 6) for r in df.select(x.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [0.707107, 0.0, 0.0]
    assert all(abs(v - 2**-0.5) < 1e-12 for v in df.select(x.unit(F.col("b"))).head()[0])


DIFFERENT = [
    ("AI", "AM"), ("AI", "IS"), ("GAN", "gin"), ("LED", "lead"), ("Faster R-CNN", "Fast R-CNN"), ("литий-ионный аккумулятор", "натрий-ионный аккумулятор"), ("модель", "моделирование"), ("сеть", "сетка"), ("ИИ", "и"),
    ("C", "C++"), ("C", "C#"), ("C++", "C#"), ("F#", "F"), ("LoRA", "LoRa"), ("language model", "model language"), ("x", None),
]
SAME = [
    ("models", "model"), ("LLMs", "LLM"), ("LEDs", "LED"), ("batteries", "battery"), ("LARGE LANGUAGE MODELS", "large language model"), ("языковая модель", "языковые модели"), ("большие языковые модели", "больших языковых моделей"),
    ("квантовый отжиг", "квантового отжига"), ("федеративное обучение", "федеративного обучения"), ("нейронная сеть", "нейронных сетей"), ("цифровой двойник", "цифровые двойники"), ("твердотельный аккумулятор", "твердотельных аккумуляторов"),
    ("интернет вещей", "интернета вещей"), ("ёмкостный датчик", "емкостные датчики"), ("БОЛЬШИЕ ЯЗЫКОВЫЕ МОДЕЛИ", "большая языковая модель"), ("C++", "c++"), ("GPT-4", "GPT4"), ("H100", "H 100"), ("С", "C"), ("СО2", "CO2"),
    ("Тrаnsformer", "Transformer"), ("cеть", "сеть"), ("захват CO2", "захват СО2"), ("naïve Bayes", "naive Bayes"), ("ＧＰＴ－４", "GPT-4"),
]


def test_names(spark):
    df = spark.createDataFrame([(*p, False) for p in DIFFERENT] + [(*p, True) for p in SAME], "a string, b string, same boolean")
    wrong = df.where((li.lexical_key("a") == li.lexical_key("b")) != F.col("same")).collect()
    assert wrong == []
    stems = {"важнейшими": "важн", "вагоном": "вагон", "падаль": "падал", "противоположностью": "противоположн", "делавшиеся": "дела", "красивейшая": "красив", "бывшего": "бывш"}
    assert {w: lexical.russian_stem(w) for w in stems} == stems
    pairs = {
        ("GPT-3", "GPT-4"): ("different numbers or versions", "spelling variant"), ("LSTM", "GRU"): ("different acronyms", None), ("non-linear model", "linear model"): ("negation on one side", "words contained"),
        ("MobileNet V2", "MobileNetV2"): (None, "words contained"), ("LLM", "large language model"): (None, "acronym expansion"), ("data base", "database"): (None, "words contained"), ("tokenisation", "tokenization"): (None, "spelling variant"), ("cat", "dog"): (None, None), (None, "x"): (None, None),
    }
    df = spark.createDataFrame([*pairs], "a string, b string")
    assert [tuple(r) for r in df.select(li.variant_reason("a", "b"), li.lexical_support("a", "b")).collect()] == list(pairs.values())
    assert one(spark, "Acme Robotics, Inc.", li.company_key) == "acme robotics"
    assert one(spark, "Technical University of X", li.organization_type) == "university"
    keys = spark.createDataFrame([("de ", "Country"), ("Xx", "Country"), ("de", "Technology")], "n string, k string")
    assert [r[0] for r in keys.select(li.identity_key(F.col("n"), F.col("k"), F.array(F.lit("DE"), F.lit("FR")))).collect()] == ["iso:DE", "xx", "de"]


def test_settled_kinds(spark):
    votes = [(1, "Material", "Technology"), (1, "Material", "Technology"), (1, "Technology", "Technology"), (2, "Method", "Method"), (2, "Technology", "Method"), (3, "Organization", "Organization"), (3, "Organization", "Organization"), (3, "Company", "Organization"), (4, "Task", "Company"), (5, None, "Metric")]
    got = li.settled_kinds(spark.createDataFrame(votes, "c long, kind string, now string"), "c", "kind", "now").collect()
    assert {r.c: r.kind for r in got} == {1: "Material", 2: "Technology", 3: "Company", 4: "Company"}


def test_blocks_chunks_sentences(spark):
    html = "<html><body><nav>menu</nav><h1>Top</h1><p>One <b>bold</b> &amp; more</p><h2>Sub</h2><ul><li>a</li><li>b</li></ul><script>x()</script></body></html>"
    assert [(h, t) for _, h, t in tx.html_blocks(html)] == [("", "Top"), ("Top", "One bold & more"), ("Top", "Sub"), ("Top > Sub", "a"), ("Top > Sub", "b")]
    assert tx.html_blocks(None) == []
    text = "# A\nfirst words here and more\n# B\n" + "word " * 60
    pieces = tx.chunks(text, 80)
    assert "".join(text[a:b] for a, b, _ in pieces) == text and {h for _, _, h in pieces} == {"A", "B"} and all(b - a <= 80 for a, b, _ in pieces)
    found = [text2[a:b] for text2 in ["It is 3.5 m, e.g. short. Next one! Last"] for a, b in tx.sentences(text2)]
    assert found == ["It is 3.5 m, e.g. short.", "Next one!", "Last"]
    df = spark.createDataFrame([({"b": [1, 3], "a": [0], "c": [2]},)], "m map<string,array<int>>")
    assert df.select(tx.abstract_from_index(F.col("m"))).head()[0] == "a b c b"
