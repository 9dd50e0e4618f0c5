from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import loomframe as lf
from loomframe.errors import FormulaError, LoomError
from loomframe.functions.formulas import identifiers, parse
from loomframe.functions.registry import BUILT_IN, Formula, Registry, read_formulas


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, 10.0, 2, 1.75, 70.0, "a"), (2, 20.0, 3, 1.80, 80.0, "b"), (3, 30.0, 4, 1.65, 60.0, None)], "id int, price double, quantity int, height double, weight double, s string")


@pytest.mark.parametrize(
    ("formula", "wanted"),
    [
        ("price + 2 * 3", [16, 26, 36]), ("(price + 2) * 3", [36, 66, 96]), ("quantity ** 2 ** 2", [16, 81, 256]), ("-quantity ** 2", [-4, -9, -16]), ("price / (quantity - 2)", [None, 20, 15]),
        ("price % 0", [None] * 3), ("1.5e1 + .5", [15.5] * 3), ("if_else(s is null, 1, 0)", [0, 0, 1]), ("max(price, 25) - min(quantity, 3)", [23, 22, 27]), ("round(height, 1)", [1.8, 1.8, 1.7]),
        ("2 - -3", [5] * 3), ("10 - 4 - 3", [3] * 3), ("mean(1, 2, 3)", [2] * 3), ("if_else(s in ('a', 'b') and not quantity = 3, 1, 2)", [1, 2, 2]),
    ],
)
def test_values(df, formula, wanted):
    got = [r.x for r in lf.transform("@calc", df, expression=formula, name="x").orderBy("id").collect()]
    assert got == pytest.approx(wanted) if None not in wanted else got == wanted


def test_golden_bmi(df):
    got = [r.bmi for r in lf.formulas.bmi(df).orderBy("id").collect()]
    assert got == pytest.approx([22.857, 24.691, 22.039], abs=1e-3)


@pytest.mark.parametrize("text", ["a + @", "", "()", "(a + b", "a b", "a +", "1x", "f(1", "a..days", "a = = b", "nosuch(1)", "sqrt(1, 2)"])
def test_errors(df, text):
    with pytest.raises(FormulaError) as e:
        lf.transform("@calc", df.withColumn("a", df.price).withColumn("b", df.price), expression=text)
    assert e.value.position >= 0


def test_unknown_column(df):
    with pytest.raises(FormulaError, match="pryce"):
        lf.transform("@calc", df, expression="pryce * 2")


def test_names_and_chain(df):
    assert lf.transform("@calc", df, expression="price").columns[-1] == "result"
    assert lf.transform("@calc", df, expression=["price", "result_0 * 2"]).columns[-2:] == ["result_0", "result_1"]
    with pytest.raises(LoomError):
        lf.transform("@calc", df, expression=["price"], name=["a", "b"])
    with pytest.raises(LoomError, match="named formula"):
        lf.transform("@calc", df, expression="inbuilt:bmi")


def test_every_formula_parses():
    assert len(BUILT_IN) == 73
    assert all(identifiers(f.expression) for f in BUILT_IN.values())


def test_age(spark):
    df = spark.sql("SELECT date_sub(current_date(), 36525) AS birth_date")
    assert lf.formulas.age_years(df).first().age_years == pytest.approx(100.0)


def test_user_folder(tmp_path, df):
    (tmp_path / "own.add").write_text('[bmi]\nexpression = "weight * 2"\ndescription = "d"\ncategory = "c"\noutput_column = "double_weight"\n[bmi.inputs]\nweight = { unit = "kg" }\n')
    (tmp_path / "rules.add").write_text('[reconciliation]\nname = "lab"\n[aliases]\nweight = ["mass", "wt"]\n[groups]\nvitals = ["weight", "height"]\n')
    r = Registry(tmp_path)
    assert r.bmi(df).columns[-1] == "double_weight"
    assert r.find("inbuilt:bmi").expression != r.find("user:bmi").expression
    assert r.reconciliation("lab").aliases["weight"] == ["mass", "wt"]
    own, _ = read_formulas(r.find("bmi").as_toml())
    assert own["bmi"] == r.find("bmi")


def test_mapping_is_by_name_not_text(df):
    f = Formula("x", "price * price_2", "d")
    from loomframe.functions.formulas import renamed

    assert identifiers(renamed(parse(f.expression), {"price": "p"})) == ["p", "price_2"]


@pytest.mark.parametrize("text", ['[to]\nexpression="a"\ndescription="d"\ncategory="c"', '[x]\nexpression="a"', '[x]\nexpression="a;b"\ndescription="d"\ncategory="c"', '[x]\nsha="1"\nexpression="a"\ndescription="d"\ncategory="c"', "[x"])
def test_bad_files(text):
    with pytest.raises(LoomError):
        read_formulas(text)


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.integers(0, 9).map(str), lambda x: st.tuples(x, st.sampled_from(["+", "-", "*"]), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), max_leaves=12))
def test_parser_agrees_with_python(text):
    def value(n):
        if n.kind == "number":
            return n.value
        a, b = map(value, n.parts)
        return {"+": a + b, "-": a - b, "*": a * b}[n.value]

    assert value(parse(text)) == eval(text)


def test_every_formula_agrees_with_python(spark):
    names = sorted({i for f in BUILT_IN.values() for i in identifiers(f.expression) if i not in ("birth_date", "date_of_birth")})
    row = {n: 2.0 + 0.37 * k for k, n in enumerate(names)}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{n}` double" for n in row))
    for name, f in BUILT_IN.items():
        if "today" in f.expression or "if_else" in f.expression:
            continue
        df = lf.formulas.apply(df, name, output=f"out_{name}")
    got = df.first()
    for name, f in BUILT_IN.items():
        if f"out_{name}" in df.columns:
            assert got[f"out_{name}"] == pytest.approx(eval(f.expression, {}, row)), name
