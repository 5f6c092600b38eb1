"""Labelled documents on which the paragraph rules of problem 1 are induced.

They are composed from a seed, a bounded number of documents (a parameter).
Words and sentences are this module's own, the layouts follow forms met in the
paragraphs: prose in several languages, scripts and
layouts, headings and signatures; lists, tables and junk in many layouts.
"""

from __future__ import annotations

import random
import string

SUBJECTS = ["la comisión", "el instituto", "una auditora", "el laboratorio", "la cooperativa", "el municipio vecino", "la junta de usuarios", "el observatorio", "la empresa de aguas", "el equipo de campo"]
VERBS = ["recomendó", "descartó", "informó de", "evaluó", "aplazó", "va a revisar", "podrá cubrir", "no pudo medir", "discute", "publicará"]
OBJECTS = ["la compra de materiales", "el cierre de dos puentes", "los caudales del año", "un plan de mejora", "la tarifa nocturna", "el mapa de suelos", "las obras del canal", "la revisión de cuentas", "el catálogo de semillas", "los contratos de limpieza"]
TAILS = ["en los distritos del sur", "porque faltaban datos", "aunque la lluvia fue escasa", "por el aumento de los precios", "según el último censo", "durante la temporada seca", "con cargo al fondo común", "y con ello bajó el consumo", "sin que cambiara el total", "tras una larga consulta"]
OTHER = [
    "The committee says that the new bridge will be closed for most of the year.", "Prices rose by 3.4 percent, and the office expects a further rise in May.", "Most of the fields were flooded, although the harvest was not lost.",
    "O comitê informou que a obra não será entregue neste ano.", "Em 2014, a produção chegou a 13,2 por cento do total, ante 9 em 2013.", "A secretaria disse que os dados são de boa qualidade.",
    "委员会认为今年的产量将会上升。", "地方政府没有公布新的数据，但价格保持稳定。", "今年の収穫は昨年より少ない見込みです。", "水位は安定しています（約40センチ）。",
    "समिति ने नई योजना की समीक्षा की।", "इस वर्ष वर्षा कम रही।", "وصلت الكمية إلى 40 طنا في العام الماضي.", "تمت مراجعة الخطة الجديدة.", "ราคาข้าวเพิ่มขึ้นในปีนี้", "คณะกรรมการเสนอให้ทบทวนแผน",
]
PLACES = ["Valle Alto", "Cusco", "Puerto Nuevo", "San Isidro", "Las Lomas", "Tarma"]
#: Sentences full of figures, by script, with what stands between two of them.
NUMBERED = [
    ("预计{y}年产量增加{a}%，比{n}年多{a}个百分点。", ""), ("水位会上升，占总量的{a}%。", ""), ("{y}年の収穫は{n}トンで、前年比{a}%増です。", ""), ("{y}년 생산량은 {n}톤으로 {a}% 늘었다.", " "), ("उत्पादन {y} में {a} प्रतिशत बढ़ेगा।", " "), ("बैठक में {n} योजनाओं की समीक्षा की गई।", " "),
    ("بلغت الكمية {n} طنا في عام {y}.", " "), ("ราคาข้าวเพิ่มขึ้น{a}%ในปี{y}", " "), ("เสนอให้ทบทวน{n}โครงการ", " "), ("In {y}, output reached {a} percent of the total, against {n} in {y}.", " "), ("Em {y}, a produção chegou a {a} por cento, ante {n} em {y}.", " "), ("В {y} году выпуск вырос на {a}% и достиг {n} тонн.", " "),
]
TITLES = ["Informe sobre el canal", "Análisis de los suelos y de las lluvias", "Anexo 4: mapas del valle", "CONCLUSIONES", "Jefa de la oficina de riego", "Cusco, 3 de abril de 2011", "Revisión de la tarifa", "Capítulo 2. El agua", "Director del museo", "Nota preliminar", "Estado de las carreteras en el norte", "Annual report of the board", "Visión general"]
ITEMS = ["compra de bombas", "el mapa de suelos", "limpieza de acequias en Tarma", "gasto en cercos", "S/ 4 200 para semillas", "la tarifa nocturna", "ajuste de 12,4 metros", "Revisar el caudal y el nivel", "Entregar los planos de la obra", "Medir en 3,1% las pérdidas", "La junta deberá cerrar las compuertas en abril", "talleres de capacitación", "Informar a los vecinos de la ribera", "cierre de cuentas del proyecto de forestación en la ladera norte"]
ROWS = ["trigo", "cebada", "maíz amarillo", "canal norte", "consumo de agua", "Valle Alto", "pérdida media", "costo del riego", "papa", "caudal mínimo del río", "costo de la limpieza de canales", "aporte de las juntas de riego", "gasto en semillas y abonos", "saldo de la caja de usuarios"]
SITE = ["Inicio", "Buscar", "Contacto", "Portada", "Archivo", "Ayuda", "Español", "English", "Iniciar sesión", "Suscripción", "Anterior", "Siguiente", "Términos de uso", "Noticias", "Enlaces", "Enviar", "Ver todo"]


def _sentence(r: random.Random) -> str:
    s = " ".join([r.choice(SUBJECTS), r.choice(VERBS), r.choice(OBJECTS), r.choice(TAILS)])
    kind = r.random()
    if kind < 0.15:
        s = f"en {r.randint(1990, 2030)}, el caudal pasó de {r.randint(1, 40)},{r.randint(0, 9)} a {r.randint(1, 40)},{r.randint(0, 9)} metros y el costo fue de S/ {r.randint(1, 40)} {r.randint(100, 999)} millones"
    elif kind < 0.22:
        s = f"los valores fueron {', '.join(f'{r.randint(1, 40)},{r.randint(0, 9)}' for _ in range(4))} por ciento en 2006, 2008, 2011 y 2015, respectivamente"
    elif kind < 0.3:
        s = f"se proponen tres medidas: (i) que {r.choice(SUBJECTS)} pague; (ii) que se cierre el paso; y (iii) que nadie riegue de noche"
    elif kind < 0.35:
        s = f"hay dos opciones: 1) cambiar {r.choice(OBJECTS)}; 2) esperar"
    elif kind < 0.4:
        s = f"el Dr. A. B. Roca firmó la nota N.° {r.randint(1, 99)} (v. cap. {r.randint(1, 9)}) de la empresa Agua S.A."
    elif kind < 0.6:
        s += f", y {r.choice(SUBJECTS)} {r.choice(VERBS)} {r.choice(OBJECTS)}"
    return s[0].upper() + s[1:] + r.choice([".", ".", ".", ".", "?", "!"])


def _wrap(text: str, width: int) -> str:
    out, line = [], ""
    for w in text.split(" "):
        if line and len(line) + len(w) + 1 > width:
            out.append(line)
            line = w
        else:
            line = f"{line} {w}" if line else w
    return "\n".join([*out, line])


def _prose(r: random.Random) -> str:
    kind = r.random()
    if kind < 0.2:
        return r.choice([*TITLES, f"Presidenta del Instituto Nacional de Riego de {r.choice(PLACES)}", f"{r.choice(PLACES)}, {r.randint(1, 30)} de julio de {r.randint(1990, 2030)}", f"Estado de {r.choice(OBJECTS)} en {r.choice(PLACES)}", f"Anexo {r.randint(1, 99)}: {r.choice(OBJECTS)} en {r.choice(PLACES)}", f"Nota sobre {r.choice(OBJECTS)}", f"Director de la Junta de Riego de {r.choice(PLACES)}", f"Revisión de {r.choice(OBJECTS)} y de {r.choice(OBJECTS)}", f"Ing. {r.choice(PLACES)} Roca Salas, Director del Museo de {r.choice(PLACES)}"])
    if kind < 0.4:
        if r.random() < 0.5:
            form, gap = r.choice(NUMBERED)
            return gap.join(form.format(a=f"{r.randint(1, 99)}.{r.randint(0, 9)}", y=r.randint(1990, 2030), n=r.randint(1, 999)) for _ in range(r.randint(1, 6)))
        group = r.choice([OTHER[:3], OTHER[3:6], OTHER[6:8], OTHER[8:10], OTHER[10:12], OTHER[12:14], OTHER[14:16]])
        return ("" if group[0][0] > "　" else " ").join(r.choices(group, k=r.randint(1, 6)))
    t = (r.choice([" ", " ", " ", "  "])).join(_sentence(r) for _ in range(r.randint(1, 8)))
    if r.random() < 0.35:
        width = r.randint(42, 110)
        t = _wrap(t, width)
        if r.random() < 0.3:
            t += r.choice(["\n", "\n "]) + _wrap(" ".join(_sentence(r) for _ in range(r.randint(1, 4))), width)
    elif r.random() < 0.14:
        t = t.replace(". ", ".\n", r.choice([1, 2, 9]))
        if r.random() < 0.5:
            t = "\n".join(_wrap(x, r.randint(50, 90)) for x in t.split("\n"))
    if r.random() < 0.15:
        t = t[: r.randint(len(t) // 2, len(t))] + r.choice(["", "", "…", "..."])
    if r.random() < 0.06:
        t = t.upper()
    if r.random() < 0.06:
        t = t.replace(".", ";")
    if r.random() < 0.06:
        t = t.replace(". ", ".")
    if r.random() < 0.08:
        t += " A saber:"
    return t


def _index(r: random.Random) -> str:
    """Items with page numbers, in any case and with any end."""
    items = [_long_item(r) if r.random() < 0.4 else r.choice(ITEMS) for _ in range(r.randint(3, 9))]
    if r.random() < 0.5:
        items = [x[0].lower() + x[1:] for x in items]
    end, page = r.choice([".", ".", ";", ""]), r.randint(1, 30)
    out = [f"{x}{end}  {page + 2 * k}" for k, x in enumerate(items)]
    return "\n".join([r.choice(["Se detallan:", "Contenido:"]), *out] if r.random() < 0.3 else out)


def _long_item(r: random.Random) -> str:
    return r.choice(
        [
            f"{r.choice(['Revisar', 'Difundir', 'Aprobar', 'Medir'])} {r.choice(OBJECTS)} y {r.choice(OBJECTS)}",
            f"{r.choice(SUBJECTS)} deberá atender {r.choice(OBJECTS)} {r.choice(TAILS)}",
            f"Bajar en {r.randint(1, 40)},{r.randint(0, 9)}% {r.choice(OBJECTS)} en Valle Alto",
            f"Avance de {r.choice(OBJECTS)} por {r.choice(SUBJECTS)}",
        ]
    )


def _list(r: random.Random) -> str:
    n = r.randint(3, 10)
    case = r.random() < 0.3
    long = r.random() < 0.45
    pool = [_long_item(r) for _ in range(n)] if long else r.choices(ITEMS, k=n)
    items = [x[0].upper() + x[1:] if case or long else x for x in pool]
    mark = r.choice(["", "", "• ", "- ", "– ", "* ", "1", "1)", "a", "i", "▪ ", ""])
    roman = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"]
    lead = {"1": [f"{k}. " for k in range(1, 11)], "1)": [f"{k}) " for k in range(1, 11)], "a": [f"{c}) " for c in "abcdefghij"], "i": [f"{c}. " for c in roman]}.get(mark, [mark] * 10)
    end = r.choice(["", "", ";", ".", ""])
    tail = [f"  {k}" for k in range(3, 33, 3)] if r.random() < 0.4 else [""] * 10
    out = [a + x + end + b for a, x, b in zip(lead, items, tail)]
    if r.random() < 0.25:
        out.insert(0, r.choice(["Se detallan:", "Son los siguientes:", "A saber:"]))
    return (" " if mark in ("• ", "- ", "– ", "* ", "▪ ") and r.random() < 0.4 else "\n").join(out)


def _inline(r: random.Random) -> str:
    mark = r.choice(["• ", "- ", "– ", "* ", "▪ "])
    items = [_long_item(r) if r.random() < 0.5 else r.choice(ITEMS) for _ in range(r.randint(3, 9))]
    return r.choice(["", "Se detallan: ", "Son los siguientes: "]) + r.choice([" ", "; ", " "]).join(mark + x for x in items)


def _cell(r: random.Random) -> str:
    return r.choice([f"{r.randint(-9, 90)},{r.randint(0, 9)}", f"{r.randint(200, 9999)}", f"{r.randint(1, 90)} {r.randint(100, 999)}", "n.d.", f"{r.randint(-9, 90)},{r.randint(0, 9)}", "-", f"{r.randint(1, 99)}%"])


def _table(r: random.Random) -> str:
    cols, sep = r.randint(2, 6), r.choice(["\t", " | ", " ; ", "  ", " "])
    rows = [[r.choice(ROWS)] + [_cell(r) for _ in range(cols)] for _ in range(r.randint(2, 8))]
    if r.random() < 0.5:
        rows.insert(0, ["Concepto"] + [str(2010 + k) for k in range(cols)])
    return (" " if r.random() < 0.2 else "\n").join(sep.join(x) for x in rows)


def _junk(r: random.Random) -> str:
    n = r.randint(60, 280)
    kind = r.randrange(8)
    if kind == 0:
        return "".join(r.choices(string.ascii_letters + string.digits + "+/", k=n))
    if kind == 1:
        return " ".join("".join(r.choices("bcdfghjklmnpqrstvwxz01|áe", k=r.randint(1, 9))) for _ in range(n // 6))
    if kind == 2:
        return " ".join("".join(r.choices("=<>|%&#~^*_/\\¬¦°·", k=r.randint(1, 6))) for _ in range(n // 4))
    if kind == 3:
        w = r.choice(["XX ", "N° ", "ja", "xo", "—", "-", ". ", "ab ", "== ", "0 ", "Pág. ", "oh", "a"])
        return (w * n)[:n]
    if kind == 4:
        return " ".join(r.choices(["<td>", "</div>", "null", "&nbsp;", "{}", "[12]", "(cid:31)", "0x4F", "<br/>", "[7]", "(cid:4)", "0xD1"], k=n // 5))
    if kind == 5:
        return r.choice([" / ", " > ", " | ", " · ", "\n", "\n", " ", " "]).join(r.sample(SITE, r.randint(4, 9)))
    if kind == 6:
        return "\n".join(f"{r.choice(OBJECTS)} {'.' * r.randint(8, 50)} {r.randint(1, 99)}" for _ in range(r.randint(2, 8)))
    return " ".join(f"{r.choice(OBJECTS)} {'.' * r.randint(8, 30)} {r.randint(1, 99)}" for _ in range(r.randint(2, 6)))


def documents(n: int = 9000, seed: int = 11) -> list[tuple[str, str]]:
    """(text, label) of ``n`` labelled documents; labels are prose, list, table, junk."""
    r = random.Random(seed)
    makers = [("prose", _prose), ("prose", _prose), ("list", _list), ("list", _inline), ("list", lambda r: _index(r) if r.random() < 0.3 else _list(r)), ("table", _table), ("junk", _junk)]
    out = []
    for _ in range(n):
        label, make = r.choice(makers)
        out.append((make(r), label))
    return out
