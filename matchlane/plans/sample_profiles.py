"""Candidate profiles, jobs and completions derived from the benchmark tables.

The tables hold no candidates, so customers become candidates, their orders
career entries, their order lines skill claims and their events activity.  The
result has the raw profile schema and goes through the normal readers.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlane.functions.binding import literal_table
from matchlane.operators.joins import BROADCAST_BYTES, join_lookup
from matchlane.session import size_of

# Dimensions, picked by position.
TITLES = [
    "Senior Machine Learning Engineer", "Search Engineer", "NLP Engineer", "Data Scientist",
    "Data Engineer", "Senior Software Engineer", "Full Stack Developer", "Frontend Engineer",
    "DevOps Engineer", "QA Engineer", "Computer Vision Engineer", "Marketing Manager",
    "Director of Engineering", "Head of Sales", "Recommendation Systems Engineer", "Product Manager",
]
COMPANIES = [
    "TCS", "Infosys", "Wipro", "Accenture", "Swiggy", "Flipkart", "Motorola", "Zomato",
    "Northwind", "Contoso", "HCL Technologies", "",
]
CITIES = [
    "Pune, Maharashtra", "Noida, Uttar Pradesh", "Bengaluru, Karnataka", "Hyderabad, Telangana",
    "Kolkata, West Bengal", "Indore, Madhya Pradesh", "Toronto, Ontario", "Berlin", "New Delhi, Delhi",
]
COUNTRIES = ["India", "India", "India", "India", "India", "India", "Canada", "Germany", "India"]
SKILLS = [
    "FAISS", "Pinecone", "LangChain", "RAG", "Prompt Engineering", "LoRA", "Elasticsearch",
    "Learning to Rank", "XGBoost", "NLP", "PyTorch", "Python", "Postgres", "PySpark", "Airflow",
    "OpenCV", "YOLO", "Speech Recognition", "Excel", "Photoshop", "Sentence Transformer",
    "Recomendation Systems", "C", "Kubernetes",
]
LEVELS = ["beginner", "intermediate", "advanced", "expert"]
PHRASES = [
    "Built vector search over product data.", "Ran weekly reporting.",
    "Owned ranking experiments.", "Maintained internal tools.",
    "Supported field teams.", "Migrated billing services.",
]
DEGREES = ["B.Tech", "M.Tech", "B.Sc", "MBA"]
SIZES = ["1-10", "11-50", "51-200", "201-500", "501-1000", "1001-5000", "5001-10000", "10001+"]
MODES = ["remote", "hybrid", "onsite", "flexible"]
REFERENCE_DATE = "2024-02-01"


def pick(values: list[str], position: Column) -> Column:
    return F.element_at(literal_table(values, "array<string>"), position.cast("int") + 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidate_id(key: Column) -> Column:
    """Seven digits at least; longer keys keep all of theirs."""
    return F.format_string("CAND_%07d", key.cast("bigint"))


def candidate_key(candidate_id: Column) -> Column:
    return F.regexp_extract(candidate_id, "([0-9]+)$", 1).cast("bigint")


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: all orders as career entries, newest first."""
    orders = table(spark, sf_dir, "orders")
    texts = table(spark, sf_dir, "benchmark")
    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.asc("o_orderkey"))
    ranked = orders.select(
        "o_custkey",
        "o_orderkey",
        "o_orderdate",
        "o_totalprice",
        "o_orderstatus",
        "o_orderpriority",
        F.row_number().over(newest).alias("pos"),
        (F.col("o_orderkey") % texts.agg(F.count("*")).scalar()).alias("item_id"),
    )
    key, current = F.col("o_orderkey"), (F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 5 == 0)
    months = (F.floor("o_totalprice") % 60 + 1).cast("bigint")
    role = F.struct(
        "pos",
        pick(COMPANIES, key % 12).alias("company"),
        pick(TITLES, key % 16).alias("title"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_date"),
        F.when(~current, F.date_format(F.add_months("o_orderdate", months.cast("int")), "yyyy-MM-dd")).alias(
            "end_date"
        ),
        months.alias("duration_months"),
        current.alias("is_current"),
        F.col("o_orderpriority").alias("industry"),
        pick(SIZES, key % 8).alias("company_size"),
        F.concat_ws(" ", pick(PHRASES, key % 6), "text").alias("description"),
    )
    return (
        join_lookup(ranked, texts, ["item_id"], F.col("o_orderkey"), "left")
        .groupBy("o_custkey")
        .agg(F.array_sort(F.collect_list(role)).alias("roles"))
    )


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: at most one claim per skill of the dimension."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_partkey") % len(SKILLS)).alias("pos"), "l_quantity", "l_discount"
    )
    k, pos = F.col("o_custkey"), F.col("pos")
    padded = k % 11 == 0
    claim = F.struct(
        "pos",
        pick(SKILLS, pos).alias("name"),
        F.when(padded, F.lit("expert")).otherwise(pick(LEVELS, (k + pos) % 4)).alias("proficiency"),
        F.when(padded, F.lit(0)).otherwise(F.col("qty")).cast("bigint").alias("endorsements"),
        F.when(padded, F.lit(1)).otherwise(F.col("n") * 6).cast("bigint").alias("duration_months"),
        F.when(~padded & ((k + pos) % 3 == 0), F.round(F.col("disc") * 1000, 0)).alias("assessment"),
    )
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "pos")
        .agg(F.max("l_quantity").alias("qty"), F.count("*").alias("n"), F.max("l_discount").alias("disc"))
        .groupBy("o_custkey")
        .agg(F.array_sort(F.collect_list(claim)).alias("claims"))
    )


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(
            F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"),
            F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"),
            F.avg((kind == "click").cast("double")).alias("response"),
            F.avg((kind != "error").cast("double")).alias("interview"),
            F.count_if(kind == "purchase").alias("saved"),
        )
    )


def raw_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw profile per customer (the schema of ``sources.candidates``)."""
    documents = table(spark, sf_dir, "documents")
    customers = table(spark, sf_dir, "customer").withColumn(
        "doc_id", F.col("c_custkey") % documents.agg(F.count("*")).scalar()
    )
    texts = documents.select("doc_id", "text")
    # Texts that fit into every task are added to the joined rows, so that no shuffle carries them.
    small = size_of(texts) <= BROADCAST_BYTES
    joined = (
        (customers if small else customers.join(texts, "doc_id", "left"))
        .join(_roles(spark, sf_dir).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
        .join(_claims(spark, sf_dir).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
        .join(_activity(spark, sf_dir).withColumnRenamed("user_id", "c_custkey"), "c_custkey", "left")
    )
    joined = joined.join(F.broadcast(texts), "doc_id", "left") if small else joined
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    title, company = pick(TITLES, (k * 7) % 16), pick(COMPANIES, k % 12)
    swapped = k % 9 == 4
    assessed = F.filter("claims", lambda c: c["assessment"].isNotNull())
    end_year = (F.lit(1985) + k % 30).cast("bigint")
    degree = F.struct(
        F.concat(F.lit("University "), nation.cast("string")).alias("institution"),
        pick(DEGREES, k % 4).alias("degree"),
        F.lit("Computer Science").alias("field_of_study"),
        (end_year - 4).alias("start_year"),
        end_year.alias("end_year"),
        F.lit(None).cast("string").alias("grade"),
        F.lit("tier_2").alias("tier"),
    )
    return joined.select(
        candidate_id(k).alias("candidate_id"),
        F.struct(
            F.col("c_name").alias("anonymized_name"),
            F.concat_ws(" ", title, F.lit("in"), "c_mktsegment").alias("headline"),
            F.col("text").alias("summary"),
            pick(CITIES, nation % 9).alias("location"),
            pick(COUNTRIES, nation % 9).alias("country"),
            (F.floor(F.abs("c_acctbal") / 50) / 10).alias("years_of_experience"),
            title.alias("current_title"),
            company.alias("current_company"),
            pick(SIZES, k % 8).alias("current_company_size"),
            F.col("c_mktsegment").alias("current_industry"),
        ).alias("profile"),
        F.transform("roles", lambda r: r.dropFields("pos")).alias("career_history"),
        F.when(nation % 4 != 0, F.array(degree)).alias("education"),
        F.transform("claims", lambda c: c.dropFields("pos", "assessment")).alias("skills"),
        F.struct(
            F.lit(75.0).alias("profile_completeness_score"),
            F.when(swapped, F.col("last_day")).otherwise(F.col("first_day")).alias("signup_date"),
            F.when(swapped, F.col("first_day")).otherwise(F.col("last_day")).alias("last_active_date"),
            (k % 3 == 0).alias("open_to_work_flag"),
            nation.cast("bigint").alias("profile_views_received_30d"),
            (nation % 5).cast("bigint").alias("applications_submitted_30d"),
            F.col("response").alias("recruiter_response_rate"),
            F.lit(12.0).alias("avg_response_time_hours"),
            F.map_from_entries(
                F.transform(assessed, lambda c: F.struct(c["name"], c["assessment"].cast("double")))
            ).alias("skill_assessment_scores"),
            (k % 500).alias("connection_count"),
            (k % 70).alias("endorsements_received"),
            ((k * 13) % 181).alias("notice_period_days"),
            F.struct(
                F.floor(F.abs("c_acctbal") / 500).cast("double").alias("min"), nation.cast("double").alias("max")
            ).alias("expected_salary_range_inr_lpa"),
            pick(MODES, k % 4).alias("preferred_work_mode"),
            (k % 2 == 0).alias("willing_to_relocate"),
            (k % 101).cast("double").alias("github_activity_score"),
            (k % 40).alias("search_appearance_30d"),
            F.col("saved").alias("saved_by_recruiters_30d"),
            F.col("interview").alias("interview_completion_rate"),
            F.lit(0.5).alias("offer_acceptance_rate"),
            (k % 2 == 1).alias("verified_email"),
            (nation % 2 == 0).alias("verified_phone"),
            (nation % 3 == 0).alias("linkedin_connected"),
        ).alias("signals"),
    )


def job_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``jd_id, text``: one job description per benchmark passage."""
    item = F.col("item_id")
    seeded = F.when(
        item % 3 != 0,
        F.concat(
            F.lit("\nMust have: Python, "),
            pick(SKILLS, item % 24),
            F.lit(", vector database and ranking.\nNice to have: XGBoost, "),
            pick(SKILLS, (item * 5) % 24),
            F.lit(".\nDo not want: speech only profiles.\nWe offer: time."),
        ),
    ).otherwise(F.lit("\nBonus: MLOps and LoRA."))
    return table(spark, sf_dir, "benchmark").select(
        F.format_string("JD_%05d", item).alias("jd_id"),
        F.concat(
            F.when(item % 4 != 1, F.concat(F.lit("Job Description: "), pick(TITLES, item % 16), F.lit(" - Core")))
            .otherwise(F.lit("Open position")),
            F.lit("\n"),
            F.col("text"),
            F.when(
                item % 2 == 0,
                F.concat(
                    F.lit("\nExperience: "),
                    (item % 5 + 2).cast("string"),
                    F.lit(" - "),
                    (item % 5 + 6).cast("string"),
                    F.lit(" years."),
                ),
            ).otherwise(F.lit("")),
            F.when(
                item % 5 == 0, F.concat(F.lit("\nNotice: sub-"), (item % 7 * 5 + 10).cast("string"), F.lit(" days."))
            ).otherwise(F.lit("")),
            seeded,
        ).alias("text"),
    )


def profile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_index, value``: raw profiles as JSON lines, most with one defect chosen by key.

    Every tenth key (2) omits null fields, the others write them as JSON null.
    """
    raw = raw_profiles(spark, sf_dir)
    k = candidate_key(F.col("candidate_id"))
    kind = k % 10
    p, s, i = F.col("profile"), F.col("signals"), F.col("candidate_id")

    def spoil(column: Column, digit: int, other: Column) -> Column:
        return F.when(kind == digit, other).otherwise(column)

    def first(column: str, fix) -> Column:
        return F.transform(column, lambda x, at: F.when(at == 0, fix(x)).otherwise(x))

    spoiled = raw.select(
        spoil(i, 1, F.concat(F.lit("ID_"), k.cast("string"))).alias("candidate_id"),
        spoil(
            spoil(p, 3, p.withField("current_company_size", F.lit("weird"))),
            4,
            p.withField("years_of_experience", F.lit(75.5)),
        ).alias("profile"),
        spoil(
            spoil(
                F.col("career_history"),
                6,
                first("career_history", lambda r: r.withField("start_date", F.lit("2020/01/01"))),
            ),
            8,
            F.slice("career_history", 1, 0),
        ).alias("career_history"),
        spoil(F.col("education"), 7, F.flatten(F.array_repeat("education", 6))).alias("education"),
        spoil(
            F.col("skills"), 5, first("skills", lambda x: x.withField("endorsements", F.lit(-1).cast("bigint")))
        ).alias("skills"),
        spoil(
            s,
            9,
            s.withField("skill_assessment_scores", F.create_map(F.lit("Python"), F.lit(150.0))),
        ).alias("signals"),
    )
    record = F.struct(*[F.col(c) for c in spoiled.columns])
    key = candidate_key(F.col("candidate_id"))
    with_nulls = F.to_json(record, {"ignoreNullFields": "false"})
    return spoiled.select(
        key.alias("row_index"), F.when(key % 10 == 2, F.to_json(record)).otherwise(with_nulls).alias("value")
    )


def prompt_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample_id, decision, score, context``: one sample per candidate."""
    from matchlane.operators.dataset import candidate_context

    raw = raw_profiles(spark, sf_dir)
    k = candidate_key(F.col("candidate_id"))
    return raw.select(
        F.col("candidate_id").alias("sample_id"),
        F.when(k % 2 == 0, "shortlist").otherwise("reject").alias("decision"),
        F.bround(F.col("profile.years_of_experience") / 20, 4).alias("score"),
        candidate_context().alias("context"),
    )


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample_id, model, completion``: built answers (tuned) and conversation turns (base)."""
    customers = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    title, city = pick(TITLES, (k * 7) % 16), pick(CITIES, F.col("c_nationkey") % 9)
    years = F.floor(F.abs("c_acctbal") / 50).cast("string")
    fact = F.concat(F.lit('"Works as '), title, F.lit(" in "), city, F.lit('"'))
    full = F.concat(
        F.lit('Answer: {"decision":"reject","score":0.'), F.lpad(years, 3, "0"), F.lit(',"reasons":['), fact,
        F.lit(',"Has '), years, F.lit(' tickets at Contoso Labs","Knows Kubernetes and Airflow well"]} done'),
    )
    quoted = F.lit("{'decision': 'reject', 'score': 0.4, 'reasons': ['Only one short reason given']}")
    thinking = F.concat(
        F.lit('<think>maybe {no}</think>{"decision":" Shortlist ","score":0.9,"reasons":['), fact, F.lit(","), fact,
        F.lit(',7,"ok"]}'),
    )
    empty = F.lit('{"decision":"shortlist","score":"0.35","reasons":[]}')
    tuned = customers.select(
        candidate_id(k).alias("sample_id"),
        F.lit("tuned").alias("model"),
        F.when(k % 4 == 0, full).when(k % 4 == 1, quoted).when(k % 4 == 2, thinking).otherwise(empty).alias(
            "completion"
        ),
    )
    turns = table(spark, sf_dir, "conversations").select(
        candidate_id(F.col("conv_id") % customers.agg(F.count("*")).scalar()).alias("sample_id"),
        F.lit("base").alias("model"),
        F.col("text").alias("completion"),
    )
    return tuned.unionByName(turns)


# Names and headings of the derived résumés.
NAMES = ["Asha Rao", "Ravi Kumar", "Lena Maria Vogt", "tom small", "JOHN STONE", "Mei Lin"]
SUMMARY_HEADINGS = ["Summary", "PROFESSIONAL SUMMARY:", "About -"]
JOINERS = [" at ", ", ", " | "]


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, text``: one plain-text résumé per customer."""
    texts = table(spark, sf_dir, "benchmark")
    customers = table(spark, sf_dir, "customer").withColumn(
        "item_id", F.col("c_custkey") % texts.agg(F.count("*")).scalar()
    )
    joined = (
        join_lookup(customers, texts, ["item_id"], F.col("c_custkey"), "left")
        .join(_roles(spark, sf_dir).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
        .join(_claims(spark, sf_dir).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
    )
    k, nation = F.col("c_custkey"), F.col("c_nationkey")

    def role_lines(r: Column) -> Column:
        start = F.substring(r["start_date"], 1, 4).cast("int")
        until = F.when(r["is_current"], F.lit("Present")).otherwise(
            (start + F.floor(r["duration_months"] / 12)).cast("string")
        )
        return F.concat(
            r["title"], pick(JOINERS, r["pos"] % 3), r["company"], F.lit(", "), start.cast("string"),
            F.when(r["pos"] % 2 == 0, F.lit(" - ")).otherwise(F.lit(" to ")), until, F.lit("\n"), r["description"],
        )

    end = F.lit(1985) + k % 30
    study = F.when(
        nation % 2 == 0,
        F.concat(
            F.lit("University "), nation.cast("string"), F.lit(", "), pick(DEGREES, k % 4), F.lit(", Physics, "),
            (end - 4).cast("string"), F.lit(" - "), end.cast("string"),
        ),
    ).otherwise(F.concat(F.lit("College | "), pick(DEGREES, k % 4), F.lit(" "), end.cast("string")))
    return joined.select(
        F.format_string("resume_%07d.txt", k.cast("bigint")).alias("path"),
        F.concat_ws(
            "\n",
            pick(NAMES, k % 6),
            F.concat(F.lit("person"), k.cast("string"), F.lit("@example.com")),
            F.concat(pick(TITLES, (k * 7) % 16), F.lit(" for hire")),
            F.lit(""),
            pick(SUMMARY_HEADINGS, k % 3),
            "text",
            F.when(k % 7 != 3, F.concat(F.lit("Work  Experience\n"), F.array_join(F.transform("roles", role_lines), "\n"))),
            F.concat(F.lit("\nEducation\n"), study),
            F.when(
                k % 5 != 2,
                F.concat(
                    F.lit("Skills:\n"),
                    F.array_join(F.transform("claims", lambda c: c["name"]), ", "),
                    F.lit("; Go; sql • go"),
                ),
            ),
        ).alias("text"),
    )


def resume_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content``: the résumés as files, some empty or with an unknown suffix."""
    k = F.regexp_extract("path", "([0-9]+)", 1).cast("bigint")
    return resumes(spark, sf_dir).select(
        F.when(k % 10 == 7, F.replace("path", F.lit(".txt"), F.lit(".xyz"))).otherwise(F.col("path")).alias("path"),
        F.when(k % 10 == 8, F.lit("")).otherwise(F.col("text")).cast("binary").alias("content"),
    )
