"""Captions, section titles, author marks and places, rule by rule."""

from pyspark.sql import functions as F

from quire.operators import body, front


def values(spark, make, cases):
    rows = spark.createDataFrame([(i, *case) for i, case in enumerate(cases)])
    return [r[0] for r in rows.select("_1", make(*[F.col(c) for c in rows.columns[1:]]).alias("v")).orderBy("_1").select("v").collect()]


def test_captions(spark):
    cases = {
        "Tabela 1: Dados gerais": ("table", "Tabela 1", "Dados gerais"),
        "  FIGURA 12 – mapa": ("fig", "FIGURA 12", "mapa"),
        "Gráfico 3": ("fig", "Gráfico 3", ""),
        "Fig. 4. Um corte": ("fig", "Fig. 4", "Um corte"),
        "Quadro2-Casos": ("table", "Quadro 2", "Casos"),
        "Table 1 shows the sample": None,
        "Table 5 Means by group": ("table", "Table 5", "Means by group"),
        "Tabela geral": None,
        "Fig 4. Sem ponto": None,
        "A figura 3 mostra": None,
        "": None,
    }
    got = values(spark, lambda t: body.caption(t), [(t,) for t in cases])
    assert [g and (g.kind, g.label, g.caption) for g in got] == list(cases.values())
    assert values(spark, body.source_line, [("Fonte: IBGE, 2020.",), ("FUENTE . x",), ("Fonte:",), ("Fontes: a",), ("A fonte: b",)]) == ["IBGE, 2020.", "x", None, None, None]


def test_section_titles(spark):
    plain, large, small = 10.0, 11.5, 8.5
    # text, lines, size, bold, another font, italic, front matter, title
    cases = [
        ("Introdução", 1, plain, True, False, False, False, True),
        ("Introdução", 1, plain, False, False, False, False, False),
        ("1 Introdução", 1, plain, False, True, False, False, True),
        ("1.2 Um método.", 1, plain, True, False, False, False, True),
        ("Um fim de frase.", 1, plain, True, False, False, False, False),
        ("2 de maio", 1, plain, False, True, False, False, False),
        ("3 Notas", 1, plain, False, False, True, False, True),
        ("3 Notas", 1, 10.7, False, False, False, False, True),
        ("x" * 89, 1, plain, True, False, False, False, True),
        ("x" * 90, 1, plain, True, False, False, False, False),
        ("y" * 109, 1, large, False, False, False, False, True),
        ("y" * 110, 1, large, False, False, False, False, False),
        ("4 " + "z" * 120, 1, plain, True, False, False, False, True),
        ("4 " + "z" * 130, 1, plain, True, False, False, False, False),
        ("As Coisas da Vida", 1, small, False, True, False, False, True),
        ("As Coisas da Vida", 1, small, False, True, False, True, False),
        ("As Coisas da Vida", 1, small, False, True, True, False, False),
        ("As coisas da vida", 1, small, False, True, False, False, False),
        ("As Coisas da Vida", 2, small, False, True, False, False, False),
        ("Método", 4, plain, True, False, False, False, False),
        ("Tabela 1: Dados", 1, plain, True, False, False, False, False),
        ("Fonte: IBGE", 1, plain, True, False, False, False, False),
        ("Palavras-chave: lei", 1, plain, True, False, False, False, False),
        ("Silva et al mostram", 1, plain, True, False, False, False, False),
        ("Como Silva (2010a) diz", 1, plain, True, False, False, False, False),
        ("Veja p. 10", 1, plain, True, False, False, False, False),
        ("1 Introdução. 2 Métodos", 1, plain, True, False, False, False, False),
        ("Art. 5 da lei", 1, plain, True, False, False, False, False),
        ("ab", 1, plain, True, False, False, False, False),
    ]
    got = values(spark, lambda t, n, s, b, f, i, x: body.section_title(t, n, s, F.lit(10.0), b, f, i, x), [c[:-1] for c in cases])
    assert [(c[0], g) for c, g in zip(cases, got, strict=True)] == [(c[0], c[-1]) for c in cases]


def test_marks_of_authors(spark):
    cases = {
        "Ana Silva 1, 2": (["1", "2"], "Ana Silva"),
        "Bo Reis*": (["*"], "Bo Reis"),
        "Cy Dias ** †": (["**", "†"], "Cy Dias"),
        "Di Luz¹²": (["12"], "Di Luz"),
        "3 Eva Paz;": ([], "Eva Paz"),
        "Fé Sá": ([], "Fé Sá"),
        "Gil 1*,2": (["1", "*", "2"], "Gil"),
        "": ([], ""),
    }
    assert values(spark, front.markers, [(t,) for t in cases]) == [m for m, _ in cases.values()]
    assert values(spark, front.without_markers, [(t,) for t in cases]) == [n for _, n in cases.values()]


def test_places_of_affiliations(spark):
    cases = {
        "Professora da Universidade Federal do Rio de Janeiro, Rio de Janeiro - RJ, Brasil": ("Universidade Federal do Rio de Janeiro", None, "Rio de Janeiro", "RJ"),
        "Faculdade de Direito da Universidade de São Paulo, São Paulo (SP).": ("Universidade de São Paulo", "Faculdade de Direito", "São Paulo", "SP"),
        "Mestre pela Universidade X em Niterói/RJ": ("Universidade X em Niterói/RJ", None, "Niterói", "RJ"),
        "Sem lugar nem casa": (None, None, None, None),
    }
    got = values(spark, lambda t: front.affiliation(t, F.lit(False)), [(t,) for t in cases])
    assert [(g.institution, g.division, g.city, g.state) for g in got] == list(cases.values())
