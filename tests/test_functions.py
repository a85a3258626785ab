"""Examples of single functions: titles, places, salaries, the cascade, HTML, coercion."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.functions import cascade, location, salary, text, title


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("r")).first().r


@pytest.mark.parametrize(
    "name, level",
    [("Senior Welder", "senior"), ("Sénior en pâtisserie", "senior"), ("Jr. Clerk", "junior"), ("Entry-level Cook", "junior"), ("Staff Nurse Senior", "staff"), ("Team Lead", "manager"), ("Vice-President, Bread", "director"), ("Co-op in Baking", "intern"), ("Internship Coordinator", "mid"), ("Baker", "mid")],
)
def test_seniority(spark, name, level):
    assert one(spark, title.SENIORITY.column(F.col("t")), t=name) == level


@pytest.mark.parametrize("name, family", [("ML Engineer II", "MLE"), ("Research Engineer, Soil", "RS"), ("Quant", "DS"), ("ETL Engineer", "DE"), ("BI Analyst", "DA"), ("Growth Scientist", "AS"), ("GenAI Engineer", "SWE-ML"), ("Head of Ovens", "Manager"), ("Baker", "Other")])
def test_role_family(spark, name, family):
    assert one(spark, title.ROLE_FAMILY.column(F.col("t")), t=name) == family


@pytest.mark.parametrize(
    "raw, country, region, city, policy",
    [
        ("San Francisco, CA", "US", "CA", "San Francisco", None),
        ("Toronto, ON, Canada", "CA", "ON", "Toronto", None),
        ("Vancouver, British Columbia", "CA", "BC", "Vancouver", None),
        ("Remote - US", "US", None, None, "remote-na"),
        ("Hybrid - New York, NY", "US", "NY", None, "hybrid"),
        ("London, UK", None, None, "London", None),
        ("", None, None, None, None),
        (None, None, None, None, None),
    ],
)
def test_location(spark, raw, country, region, city, policy):
    got = one(spark, location.parse_location(F.col("l")), l=raw)
    assert (got.country, got.region, got.remote_policy) == (country, region, policy)
    if policy != "hybrid":
        assert got.city == city


def mined(spark, words):
    got = one(spark, salary.mine_salary(F.col("w")), w=words)
    return got and (got.salary_min, got.salary_max, got.salary_currency, got.salary_period)


@pytest.mark.parametrize(
    "words, low, high, currency, period",
    [
        ("Yearly compensation lies between the bounds $141,000 - $187,500, plus stock.", 141_000, 187_500, "USD", "year"),
        ("Wage: $96K to $121K, paid twice a quarter.", 96_000, 121_000, "USD", "year"),
        ("Expected salary CAD 118,000 to 152,000 in Halifax.", 118_000, 152_000, "CAD", "year"),
        ("Hourly rate $31.50 – $44.25 for night shifts.", 31.5, 44.25, "USD", "hour"),
        ("The range is $135,000 USD - $180,000 USD per year.", 135_000, 180_000, "USD", "year"),
        ("Base pay: USD $130,000 - USD $150,000.", 130_000, 150_000, "USD", "year"),
        ("Target pay of $135K USD to $180K USD.", 135_000, 180_000, "USD", "year"),
        ("Compensation $6,000 - $7,000 per month plus annual bonus.", 6_000, 7_000, "USD", "month"),
        ("Base salary C$88,000—C$97,000", 88_000, 97_000, "CAD", "year"),
        ("Pay range 400 widgets. Salary $450 to $600 a day on site.", 450, 600, "USD", "day"),
        ("Salary $120,000 - $90,000 in either order.", 90_000, 120_000, "USD", "year"),
        ("Wages aside, sums of $70,000 - $80,000 go to charity each spring and autumn, quite apart from anything that we would hand to staff. And then much later on: the salary is $101,000 - $102,000.", 101_000, 102_000, "USD", "year"),
    ],
)
def test_salary_mining(spark, words, low, high, currency, period):
    assert mined(spark, words) == (low, high, currency, period)


@pytest.mark.parametrize("words", ["Revenue grew from $12M - $19M in two years.", "Salary band $4,100 - $7,900 annually.", "A $75 voucher for each referral.", "Base salary from $142,000 upward.", "Pay range TBD - TBD", "", None])
def test_salary_mining_finds_nothing(spark, words):
    assert mined(spark, words) is None


@pytest.mark.parametrize(
    "field, words, value",
    [
        ("min_years_experience", "You bring 7+ yrs of field work; 2 years with us.", 7),
        ("min_years_experience", "Over 4 years exp. or 6-9 years in the field.", 6),
        ("max_years_experience", "Between 6-9 years.", 9),
        ("max_years_experience", "From 3 to 5 years.", None),
        ("min_years_experience", "A company of 88 years.", None),
        ("min_education", "Doctorate preferred.", "phd"),
        ("min_education", "Doctorate preferred, undergraduate degree is fine.", "bachelors"),
        ("min_education", "A Ph. D is required; MBA a plus.", "phd"),
        ("min_education", "B.S. in Physics", "bachelors"),
        ("min_education", "Our MS Teams rooms in Boston, MA.", None),
        ("min_education", "HS  diploma", "high_school"),
        ("clearance_level", "Holder of an active TS / SCI.", "ts_sci"),
        ("clearance_level", "Top Secret/SCI with polygraph", "ts_sci"),
        ("clearance_level", "Secret clearance held for two years", "secret"),
        ("clearance_level", "a Public  Trust post", "public_trust"),
        ("requires_security_clearance", "Public Trust is not required here.", None),
        ("requires_security_clearance", "Able to obtain a Secret clearance.", None),
        ("requires_citizenship", "Open to a U.S. citizen or a Canadian permanent resident.", ["US", "CA"]),
        ("requires_citizenship", "U.S. citizenship preferred.", None),
        ("requires_citizenship", "Restricted due to\nexport control.", ["US"]),
        ("offers_visa_sponsorship", "We are not in a position to sponsor visa holders.", "no"),
        ("offers_visa_sponsorship", "Must be legally authorized to work in the US without sponsorship.", "no"),
        ("offers_visa_sponsorship", "H-1B transfer welcome.", "yes"),
        ("offers_visa_sponsorship", "Sponsorship of local clubs.", None),
        ("remote_policy_extracted", "We are remote first, always.", "remote"),
        ("remote_policy_extracted", "Plan on 3 days onsite.", "hybrid"),
        ("remote_policy_extracted", "Plan on 1 day in office.", "hybrid"),
        ("remote_policy_extracted", "It is an on site  role, remote position never.", "remote"),
        ("remote_policy_extracted", "An on site  role.", "onsite"),
        ("on_call_required", "Expect to be on call twice a month.", True),
        ("on_call_required", "Nobody is ever not on-call here.", False),
        ("on_call_required", "A pager\nrotation of six.", True),
        ("max_travel_percent", "Roughly 25 % travel.", 25),
        ("max_travel_percent", "Travel up to 40%.", 40),
        ("max_travel_percent", "No travel at all, or 10% travel.", 0),
        ("max_travel_percent", "Up to 90% discount on rail.", None),
        ("equity_form", "Meaningful equity options.", "options"),
        ("equity_form", "Restricted stock unit grants over four years", "rsu"),
        ("equity_form", "profit sharing for all", "profit_sharing"),
        ("equity_form", "profit-sharing for all", None),
        ("equity_form", "an ownership stake", "other"),
        ("bonus_type", "A target bonus of a tenth.", "annual"),
        ("bonus_type", "Sign-on bonus and retention bonus", "signing"),
        ("bonus_type", "Some bonuses.", None),
        ("offers_relocation", "Relocation not offered.", False),
        ("offers_relocation", "Relocation assistance is not available.", True),
        ("offers_relocation", "We will help with relocation.", True),
        ("contract_type", "This is a full time job.", "full_time"),
        ("contract_type", "Twenty hours, part time.", "part_time"),
        ("contract_type", "A fixed term contract until May.", "contract"),
        ("contract_type", "A permanent\nposition", "full_time"),
        ("contract_type", "For a co-op student.", "internship"),
        ("language_requirements", "English/French bilingual, native in Spanish.", ["fr", "es"]),
        ("language_requirements", "proficient in Japanese", None),
        ("language_requirements", "流暢 ... fluent  Cantonese", ["ja", "zh"]),
        ("language_requirements", "ビジネスレベル", None),
        ("direct_reports_count", "Oversee a team of 12 scientists.", 12),
        ("direct_reports_count", "Lead 5 engineers.", None),
        ("tech_stack", "Ruby at Murray Hill, React, and pandas; sql is lower case, SQL is not.", ["Ruby", "SQL", "React", "pandas"]),
        ("tech_stack", "Dinner at Ruby Tuesday; we react to pandas in zoos.", ["React"]),
        ("tech_stack", "Go over the rust on the swift boat.", ["Rust", "Swift"]),
        ("tech_stack", "Statistics in R/Python", ["Python", "R"]),
        ("tech_stack", "A plain office.", None),
    ],
)
def test_cascade(spark, field, words, value):
    got = one(spark, cascade.extract(F.col("w"), F.lit(""))[field], w=words)
    assert (got.value if got else None) == value


@pytest.mark.parametrize("name, role, rule", [("Chief Data Officer", "exec", "exec_title"), ("Head  of Labs", "director", "director_title"), ("Sr. Manager, Ops", "senior_manager", "sr_mgr_title"), ("Lead Engineer", "tech_lead", "lead_title"), ("Engineer", None, None)])
def test_manager_roles(spark, name, role, rule):
    got = one(spark, cascade.extract(F.lit(""), F.col("t"))["manager_role"], t=name)
    assert (got.value, got.rule_id) == (role, rule) if role else got is None


@pytest.mark.parametrize("name, kind", [("  Talent pool, sales", "evergreen_pool"), ("Join our network - talent community", "talent_community"), ("Baker", "real")])
def test_posting_quality(spark, name, kind):
    assert one(spark, cascade.extract(F.lit(""), F.col("t"))["posting_quality"], t=name).value == kind


def test_spaces_of_any_kind_count(spark):
    assert one(spark, cascade.extract(F.col("w"), F.lit(""))["remote_policy_extracted"], w="fully\u00a0remote").value == "remote"


def test_provenance_and_merge(spark):
    row = cascade.with_features(spark.createDataFrame([("Engineer", "RSUs. 5+ years.")], "title string, description_md string")).first()
    assert row.extraction_meta["equity_form"].rule_id == "equity_form_rsu" and row.extraction_version == "v1"
    assert "min_education" not in row.extraction_meta


def test_coercion(spark):
    assert one(spark, cascade.coerce_bool(F.col("r")), r="Yes") is True
    assert one(spark, cascade.coerce_int(F.col("r")), r="about 12 people") == 12
    assert one(spark, cascade.coerce_enum(F.col("r"), ("full_time",)), r="Full-Time") == "full_time"
    assert one(spark, cascade.coerce_list(F.col("r")), r='["a", " ", "b"]') == ["a", "b"]


def test_html_and_dates(spark):
    assert text.markdown_of("&lt;h2&gt;Role&lt;/h2&gt;&lt;p&gt;Do &lt;b&gt;x&lt;/b&gt;&lt;/p&gt;") == "## Role\n\nDo **x**"
    assert text.markdown_of(None) == ""
    assert one(spark, text.parse_iso(F.col("d")).cast("string"), d="2026-05-08T10:00:00Z") == "2026-05-08 10:00:00"
    assert one(spark, text.parse_iso(F.col("d")), d="soon") is None
    assert one(spark, text.map_skills(F.array(F.col("s")), {"python": "Python"}), s=" Python 3. ") == ["Python"]
    french = lambda t, d: one(spark, text.is_french(F.col("t"), F.col("d"), F.lit("QC"), F.lit("")), t=t, d=d)
    assert french("Technicienne de four", "") and french(" Chef", "") and not french("Cheffing assistant", "") and not french("Analysts", "")
    assert french("x", "nous avec notre leur cette") and not french("x", "nous avec notre leur")
