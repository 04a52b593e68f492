from __future__ import annotations

import pytest

from skein.functions.sql_lineage import lineage, statements, table_edges


@pytest.mark.parametrize(
    ("text", "product", "want"),
    [
        ("select 1; select ';' ; -- x;\n", "sql", ["select 1", "select ';'"]),
        ("create function f() as $a$ select 1; $a$; select 2", "postgresql", ["create function f() as $a$ select 1; $a$", "select 2"]),
        ("DELIMITER //\ncreate procedure p() begin select 1; end//\nDELIMITER ;\nselect 2;", "mysql", ["create procedure p() begin select 1; end", "select 2"]),
        ("select 1\nGO 2\nselect 2", "tsql", ["select 1", "select 2"]),
        ("begin null end\n/\nselect 2", "oracle", ["begin null end", "select 2"]),
        ("", "sql", []), ("-- only", "sql", []),
    ],
)
def test_statements(text, product, want):
    found = statements(text, product)
    assert [s.text for s in found] == want
    assert all(text[s.start : s.end] == s.text for s in found)


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("insert into a.b select * from c left join d on true cross join e", [("writes", "a.b", "target"), ("reads", "c", "source"), ("joins", "d", "left"), ("joins", "e", "cross")]),
        ("with x as (select * from t), y as (select * from x) select * from y join t2 on 1=1", [("reads", "t", "source"), ("joins", "t2", "inner")]),
        ("create table o (id int references p(id))", [("defines", "o", "table"), ("references", "p", "foreign key")]),
        ('update "A" set x = 1 from b where c = \'from z\'', [("writes", "A", "target"), ("reads", "b", "source")]),
        ("delete from q /* from r */", [("writes", "q", "target")]), ("create or replace view v as select * from (select * from s) k", [("defines", "v", "view"), ("reads", "s", "source")]),
        ("insert into t values (1) on duplicate key update x = 2", [("writes", "t", "target")]),
    ],
)
def test_lineage(sql, want):
    assert lineage(sql) == want


def test_table_edges(spark):
    df = spark.createDataFrame([("a.sql", "insert into x select * from y; drop table z"), ("b.sql", None)], "path string, text string")
    assert sorted(tuple(r) for r in table_edges(df).collect()) == [("a.sql", 0, "reads", "y", "source"), ("a.sql", 0, "writes", "x", "target")]
