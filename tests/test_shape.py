import json
from collections import Counter

import pandas as pd
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from lariat.operators.label import create_target_variable
from lariat.operators.shape import dedupe_last, flatten_prospects, merge_all
from lariat.plans.queries import csv_round_trip
from lariat.sources.keyed_json import JOBS, PROSPECTS, read_json_lines, read_keyed_json
from lariat.sources.tables import load_and_merge, read_applicants, read_csv, write_csv


def write(path, text):
    path.write_text(text)
    return str(path)


P = """{"1": {"titulo": "t1", "modalidade": "m", "prospects": [{"codigo": "10", "situacao_candidado": "Prospect"}, {"codigo": "11.0", "situacao_candidado": "Proposta Aceita"}]},
 "2": {"prospects": []}, "3": {"titulo": "x"}, "4": {"prospects": null}, "9.0": {"prospects": [{"codigo": "77"}]},
 "1": {"titulo": "t2", "prospects": [{"codigo": "10", "nome": "N"}]}}"""


@pytest.fixture
def base(tmp_path):
    write(tmp_path / "prospects.json", P)
    write(tmp_path / "jobs.json", json.dumps({"1": {"informacoes_basicas": {"cliente": "first"}}, "1.0": {"informacoes_basicas": {"cliente": "last", "vaga_sap": "Sim"}, "perfil_vaga": {"nivel profissional": "S"}}, "5": {"informacoes_basicas": None}}))
    people = pd.DataFrame({"formacao_e_idiomas": [{"nivel_academico": "A", "nivel_ingles": "B", "nivel_espanhol": "C"}], "informacoes_profissionais": [{"area_atuacao": "TI", "conhecimentos_tecnicos": "k"}], "cv_pt": ["cv"]}, index=["10"])
    people.to_parquet(tmp_path / "applicants.parquet")
    return tmp_path


def test_flatten(spark, base):
    rows = flatten_prospects(read_keyed_json(spark, str(base / "prospects.json"), PROSPECTS)).collect()
    assert sorted((r.vaga_id, r.candidato_id, r.titulo_vaga, r.nome) for r in rows) == [("1", "10", "t2", "N"), ("9.0", "77", None, None)]
    assert len(rows[0]) == 10


def test_merge(spark, base):
    rows = {r.vaga_id: r for r in load_and_merge(spark, str(base), save=str(base / "merged")).collect()}
    assert len(rows["1"]) == 18 and rows["1"].cliente == "last" and rows["1"].sap == "Sim" and rows["1"].nivel_profissional == "S" and rows["1"].ingles == "B"
    assert rows["9"].cliente is None and rows["9"].nivel_academico is None
    assert len(rows) == 2 and (base / "merged").exists()


def test_malformed_json_fails(spark, tmp_path):
    path = write(tmp_path / "bad.json", '{"1": {')
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_keyed_json(spark, path, JOBS).collect()


def test_json_lines(spark, tmp_path):
    path = write(tmp_path / "x.jsonl", '{"k": "1", "p": 3, "value": {"titulo": "t"}}\n')
    assert read_json_lines(spark, path, "k", "p", PROSPECTS).select("key", "pos", "value.titulo").first() == ("1", 3, "t")


def test_duplicate_applicants_fail(spark, tmp_path):
    pd.DataFrame({"a": [1, 2]}, index=["x", "x"]).to_parquet(tmp_path / "a.parquet")
    with pytest.raises(ValueError):
        read_applicants(spark, str(tmp_path / "a.parquet"))


def test_lazy_applicants(spark, tmp_path):
    pd.DataFrame({"a": [1, 2]}, index=["x", "x"]).to_parquet(tmp_path / "a.parquet")
    lazy = read_applicants(spark, str(tmp_path / "a.parquet"), lazy=True)
    with pytest.raises((PySparkException, Py4JJavaError)):
        lazy.collect()
    for i in (0, 1):
        pd.DataFrame({"a": [i]}, index=[f"x{i}"]).to_parquet(tmp_path / f"part{i}.parquet")
    (tmp_path / "many").mkdir()
    for i in (0, 1):
        (tmp_path / f"part{i}.parquet").rename(tmp_path / "many" / f"part{i}.parquet")
    with pytest.raises(ValueError):
        read_applicants(spark, str(tmp_path / "many"))
    assert sorted(r.pos for r in read_applicants(spark, str(tmp_path / "many"), position="a", lazy=True).collect()) == [0, 1]


def test_training_command(spark, base, capsys):
    from lariat.plans.training import main

    rows = {str(i): {"prospects": [{"codigo": str(i), "situacao_candidado": "Proposta Aceita" if i % 3 else "Desistiu"}]} for i in range(30)}
    write(base / "prospects.json", json.dumps(rows))
    main([str(base), "--kind", "lr", "--model", str(base / "model"), "--table", str(base / "table"), "--drift", str(base / "drift")])
    assert "weighted avg" in capsys.readouterr().out and all((base / x).exists() for x in ("model", "table", "drift"))


def test_dedupe_last(spark):
    df = spark.createDataFrame([("123", 0, "a"), ("123", 1, "b"), (None, 2, "c")], "k string, pos int, v string")
    assert sorted((r.v for r in dedupe_last(df, "k", "pos").collect())) == ["b", "c"]


def test_target(spark):
    status = ["Proposta Aceita", "Entrevista Técnica", "Contratado como Hunting", "Prospect", "Contratado pela Decision", None, "prospect", "Prospect "]
    df = spark.createDataFrame([(s,) + ("x",) * 7 for s in status], "situacao string, nivel_academico string, ingles string, espanhol string, area_atuacao string, nivel_profissional string, sap string, cliente string")
    out = create_target_variable(df)
    assert out.columns[-1] == "target" and sorted(r.target for r in out.collect()) == [0, 0, 0, 1, 1, 1]


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a\n"q",b\\'), (2, ""), (3, "NA"), (4, None)], "i int, s string")
    write_csv(df, str(tmp_path / "c"))
    read = lambda **k: {r.i: r.s for r in read_csv(spark, str(tmp_path / "c"), "i int, s string", **k).collect()}
    assert read() == {1: 'a\n"q",b\\', 2: None, 3: None, 4: None}
    assert read(na_values=None)[3] == "NA"


ODD_TEXTS = [None, "", " ", " a", "a ", "\ta\t", "a\n", "\n\na", "\n", "\r", "a\r\n", 'a\r"\n', ' "a" ', '"', '""', 'a",\n"b', "a\\", '\\"', "\0", "\0\0", "\0\n", 'a\0"b', '\0,a"\0', "a\x0b", "\x01\x1f", "\u00a0a\u2028", "\ufeffa", "#a", "NA", "null", ",", "x" * 300_000 + '" \n']


def test_csv_keeps_any_text(spark, tmp_path):
    rows = [(a, i, b) for i, a in enumerate(ODD_TEXTS) for b in ODD_TEXTS[:20]]
    schema = "`a.b` string, i int, `c` string"
    write_csv(spark.createDataFrame(rows, schema), str(tmp_path / "c"))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "c"), schema, None).collect()), key=key) == sorted(rows, key=key)
    write_csv(spark.createDataFrame([(x,) for x in ODD_TEXTS], "a string"), str(tmp_path / "one"))
    assert Counter(r.a for r in read_csv(spark, str(tmp_path / "one"), "a string", None).collect()) == Counter(ODD_TEXTS)
    write_csv(spark.createDataFrame([(1,), (None,)], "i int"), str(tmp_path / "number"))
    for tokens in ({}, {"na_values": None}, {"na_values": ["NA"]}):
        assert Counter(r.i for r in read_csv(spark, str(tmp_path / "number"), "i int", **tokens).collect()) == Counter([1, None])
    write(tmp_path / "foreign.csv", 'i,s,t\r\n"","",\r\n1,"NA",x\r\n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "foreign.csv"), "i int, s string, t string").collect()] == [(None, None, None), (1, None, "x")]


def test_csv_round_trip_query(spark, tmp_path):
    """Odd texts come back, and a frame holds its own rows after a run on another input."""
    frames = {}
    for name, texts in (("x", ODD_TEXTS), ("y", ["other"])):
        spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        frames[name] = csv_round_trip(spark, f"{tmp_path}/{name}")
    assert {r.doc_id: r.text for r in frames["x"].collect()} == dict(enumerate(ODD_TEXTS))
    assert [tuple(r) for r in frames["y"].collect()] == [(0, "other")]


def test_merge_empty(spark):
    empty = lambda s: spark.createDataFrame([], s)
    jobs, prospects = empty(f"key string, pos bigint, value {JOBS}"), empty(f"key string, pos bigint, value {PROSPECTS}")
    people = empty("__index_level_0__ string, pos bigint, formacao_e_idiomas struct<nivel_academico: string, nivel_ingles: string, nivel_espanhol: string>, informacoes_profissionais struct<area_atuacao: string, conhecimentos_tecnicos: string>, cv_pt string")
    assert merge_all(jobs, people, flatten_prospects(prospects)).count() == 0
