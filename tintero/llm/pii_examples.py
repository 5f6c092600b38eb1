"""Labelled training sentences for problem 10, composed from a seed.

Every field of a pattern in braces is an entity of that kind; all else is
outside.  Names, streets and places are this module's own, so that the model
learns contexts and shapes rather than names.  A part of the sentence frames
follows frames met in the documents; another is composed of openings and
endings of this module's own.  A document has a cast of few people and places.
Some sentences say nothing about what their capitalised words are: there only
another mention in the document tells people from places and bodies.
"""

from __future__ import annotations

import random
import re

# Given names common in Spanish, Portuguese and English.
GIVEN = (
    "María José Juan Luis Carlos Jorge Pedro Ana Rosa Carmen Julio César Miguel Ángel Manuel Víctor Francisco Antonio Fernando Ricardo Roberto Eduardo Alberto Mario Raúl Óscar Hugo Iván Sergio Pablo Andrés Diego Javier Daniel David Rafael Alejandro Gabriel Martín Enrique Ramón Jesús Felipe Gustavo Guillermo Rubén Alfredo Ernesto Arturo Walter "
    "Lucía Elena Teresa Silvia Marta Patricia Claudia Gloria Juana Julia Isabel Laura Sandra Mónica Sofía Paula Andrea Beatriz Cecilia Norma Yolanda Irma Flor Nélida Edith Elizabeth Milagros Luz Margarita Susana Gladys Olga Sara Raquel Verónica Adriana Karina Vanessa Diana Wilmer Percy Abel Edwin Freddy "
    "João Paulo Marcos Antônio Thiago Rodrigo Mateus Fernanda Juliana Camila Letícia John James Robert Michael William Richard Thomas Mary Jennifer Linda Susan Karen Nancy Sarah Emily George Peter Paul Mark Steven Anne Jane Emma Alice Henry"
).split()
#: Given names and surnames that the model knows by their shape only.
OTHER = "Zbigniew Ahmed Fátima Yuki Bronislava Amaru Illari Kusi Wayra Olumide Ngozi Svetlana Dmitri Ingrid Bjørn Tariq Leilani Aiko Rashid Nayra Sumaq Katari Elvira Tiburcio Eustaquio Saturnina Hermelinda Pánfilo".split()
FAMILY = "Kowalczyk Hassan Tanaka Okafor Ivanova Lindqvist Nguyen Haddad Schneider Rossi Moreau Papadakis Horvat Silva Souza Oliveira Smith Johnson Brown Taylor Quispe Huamán Rojas Flores Mamani Castro Vargas Ramos Salazar Cárdenas Paredes Núñez Aguirre Zevallos Ibarra Ordóñez Tapia Lozano Bustíos Cáceres Ugarte Yáñez".split()
STREETS = ["Los Pinos", "San Martín", "Las Palmeras", "Almirante Grau", "Luna Clara", "El Olivar", "Rosa Castro", "Cinco Esquinas", "Monte Verde", "Carlos Vargas", "La Colina Gris", "Los Jazmines", "La Fuente Nueva", "Las Acacias", "El Molino", "Los Tres Ríos"]
PLACES = ["Valle Claro", "San Isidro", "Puerto Nuevo", "Las Lomas", "Lago Azul", "Monte Bajo", "Santa Elena", "Villa Hermosa", "Cerro Blanco", "Río Seco", "Tres Cruces", "Pampa Alta", "San Julián", "Nueva Aurora", "Bahía Mansa", "Cabo Largo", "Piedra Negra", "Santa Clara del Monte", "Cerro Blanco Alto", "Villa Hermosa Baja", "Monte Largo Chico", "Puerto Viejo Sur", "Pampa Alta Norte", "Valle Hondo Bajo", "Nueva Santa Rosa", "San Pedro Alto", "Loma Larga", "Aguas Claras", "Tierra Firme", "Campo Verde Nuevo"]
BODIES = ["el Consejo Fiscal", "la Contraloría", "el Banco Central", "el Congreso", "el Ministerio", "la Dirección de Estudios", "la oficina de deuda", "el Gobierno", "el comité revisor"]
PROSE = [
    "{B} señala que la deuda pública se reducirá en el corto plazo.", "En {L} y {L}, la brecha de vialidad se estima en S/ {n} {t} millones, de los cuales {B} cubriría {d} por ciento.", "Entre 2008 y 2019, el gasto corriente pasó de {d} a {d} por ciento del PBI por el alza de las tasas.", "La empresa Minera Andina S.A. pagó US$ {n} {t}.38 en regalías, p. ej., las de {L}.",
    "{C}, 7 de agosto. El déficit fiscal superó lo previsto en {L}.", "EL SEÑOR PRESIDENTE.— Además, {B} precisa que las cifras son preliminares.", "La señora RELATORA.— Para 2016 se proyecta que la inversión alcance {d}% del PBI.", "Señores del Consejo: Según la regla de deuda, el gasto llegaría a {d}% del PBI.", "El art. 77 del D. Leg. N.° {q} fija un tope de {d}% para el gasto en {L}.", "Los términos de intercambio con EE. UU. variaron {d} por ciento (aprox. {d} p.p. menos).",
    "La Ley N.° {v} modificó el presupuesto.", "El expediente {q}-{e} pasó a la sala.", "La partida 2.3.{n}.4 aumentó.", "El código de obra {e} registra demoras.", "El monto asciende a S/ {n} {t} {t} en la fuente ordinaria.", "Siga la etiqueta @cuentasclaras en redes.", "Con {n} soles de saldo y {n} recibos pendientes, un capataz joven de {L} vendió las mulas.", "El acta {t} de {L} cuenta que una regidora midió el canal; luego, en {L}, el juzgado cerró.", "Ni la viuda del panadero ni el perito de {L} supieron por qué el fondo cerró.",
    "La oficina queda cerca de {sT} {S}, frente al mercado.", "La obra de {sT} {S} sigue cerrada.", "{sT} {S}.", "{sT} {S}, presentó una observación.", "Remita los recibos a {sT} {S}; consultas: ver anexo.", "La Fundación {N} publicó un estudio.", "El Hospital Regional {N} ejecutó el {n}% de su presupuesto.", "El Colegio {N} recibió fondos.", "El Instituto {N} convocó al concurso.", "La Universidad {N} firmó el convenio.", "El Puente {N} se cerró en {L}.", "El parque General {F} reabrió.", "La Biblioteca Municipal {N} cerró sus puertas.",
    "En {L}, los recursos destinados a riego sumaron S/ {n} {t} millones y los de salud, S/ {n} {t} millones.", "En efecto, el corredor norte de {L} demandará S/ {n} {t} millones hasta 2015.", "Además, la ejecución en {L} llegó a {d} por ciento de lo programado.", "{C}, 21 de mayo. Si {B} postergara la regla, el gasto caería.", "e-Registro, el portal de {L}, anotó {d}% de las órdenes.",
    "En {L}, distrito de {L}, un sastre pidió congelar la renta, y a los {n} días la feria cerró.", "Cuando en {L} el obispado exigió garantías, una maestra tasó los padrones durante {n} semanas.", "La inflación fue {d}, {d}, {d} y {d} por ciento en 2018, 2007, 2005 y 2025, respectivamente.", "Boletín {n}. En {L} y {L} se midió el caudal.", "Los vecinos perdió la mitad: así resumió el síndico el pleito de {L}, que costó {t} soles y {n} noches.", "La empresa Agua Clara S.A.C. Según {B}, el gasto cedió.", "El contrato lo firmó la compañía Obras del Norte S.A.C. En {L}, la brecha sigue.", "{C}. {B} y {B} coinciden en que procede revisar el gasto.", "—Se abre la sesión. En {L}, el ahorro cedió.", "Resumen. {t} indicadores {t} sobre {L}.", "¿Qué supuesto sostiene la decisión del personaje en {L}?", "Para 2020 se proyecta que el ahorro alcance {d}% del PBI, es decir, S/ {n} {t} millones más.",
    "The Council and the debt unit agree that public debt will rise in the near term.", "In 2014, tax revenue reached {d} percent of GDP, compared with {d} percent in 2011.", "Em 2006, o déficit fiscal chegou a {d} por cento do PIB, ante {d} por cento em 2011.", "A secretaria estima que a despesa corrente superará o limite.", "Lea con atención el siguiente pasaje y responda la pregunta final.", "Fuente: www.datos.example/v{n}.{n}.", "I. Antecedentes. La revisión redujo en {d} puntos la estimación.", "Boletín N.° {n}. Si {B} postergara el plan, el gasto caería.", "A las 10.30 a. m. la sesión aprobó gastos por S/ {n} {t} millones.", "El inc. b) del num. 34.60 del marco —vigente desde 2005— no fue derogado.", "El fondo contaba con S/ 1.{t}.{q},50 al 12 de jun. de 2014.", "según consta en el exp. N.º {q}-2015.", "La nota precisa que el margen es escaso (cf. Informe Núm. {n}, párr. {n}).", "Informe N° {q}-2021-CF sobre {L}.", "{t} proyectos de riego quedaron sin fondos.", "«Hay que esperar», respondió {B} en {L}.",
]
ENTITIES = [
    "El ciudadano {NAME}, identificado con DNI N.° {ID}, pide copia del acta.", "La señora {NAME}, domiciliada en {ADDRESS}, presentó una queja.", "El señor {NAME}, con domicilio en {ADDRESS}, reclamó.", "Quien suscribe, {NAME}, con documento {ID}, declara lo siguiente.", "Factura a nombre de {NAME}, R.U.C. N.º {ID}, por alquiler.", "La empresa con RUC {ID} fija domicilio en {ADDRESS}.", "Contacto: {NAME} — cel. {PHONE}.", "Contacto: {NAME}, tel. {PHONE}; correo: {EMAIL}.", "El reclamo lo firmó {NAME} (doc. {ID}; {EMAIL}).",
    "Según don {NAME}, el trámite no avanzó.", "Según doña {NAME}, nadie respondió.", "La carta la firman {NAME} y {NAME}.", "Asistieron: {NAME}, {NAME} y {NAME}; se excusó {NAME}.", "Ayer {NAME} recordó que el plazo vence.", "Hoy {NAME} señaló que falta presupuesto.", "Intervino el regidor {NAME} para observar el gasto.", "Intervino la vecina {NAME} para pedir la palabra.", "Para devolver la llamada, marque {PHONE} y pregunte por {NAME}.", "Puede escribirse a {EMAIL} o llamar al {PHONE} para más datos.", "Mi número es {PHONE} y vivo en {ADDRESS}, frente a la plaza.",
    "Remita los documentos a {ADDRESS}; consultas: {EMAIL}.", "<{EMAIL}> escribió: espero respuesta en {ADDRESS}.", "{EMAIL} <{EMAIL}> escribió: sigo sin respuesta.", "{NAME}\n{PHONE}\n{EMAIL}", "{NAME}, DNI {ID}", "{NAME}\nDNI {ID}\n{ADDRESS}", "Atentamente,\n{NAME}\n{PHONE}", "{NAME}\n{ADDRESS}\n{PHONE}", "Contato: {EMAIL}, tel. {PHONE}.", "O cidadão {NAME}, documento {ID}, pediu o relatório.", "The complaint was filed by {NAME}, who lives at {ADDRESS}.", "Write to {EMAIL} or call {PHONE}.", "{NAME} (ID {ID}) asked for the file.", "Yesterday {NAME} spoke before the panel.", "Llamar al {PHONE} o escribir a {EMAIL}.", "A cidadã {NAME} mora na {ADDRESS}.", "Queja de {NAME} contra la oficina.", "El Dr. {NAME} y la Sra. {NAME} expusieron en {L}.", "pasaporte {ID} de {NAME}", "Recibí conforme: {NAME}, documento N.° {ID}.", "{NAME} vive en {ADDRESS}.", "Fdo. {NAME}, DNI {ID}", "Firmado: {NAME}", "{NAME}", "Atte.\n{NAME}", "Saludos,\n{NAME}\n{PHONE}\n{EMAIL}", "Lo confirmó {NAME} en la asamblea.", "La queja de doña {NAME} fue admitida.", "Hablé con {NAME} por teléfono.",
]


#: Sentences that hold a name without telling so, and the same with a place or a body.
WEAK = [
    "{X} aparece en la relación adjunta.", "La nota menciona a {X} en dos ocasiones.", "Se volvió a citar a {X}.", "El caso de {X} sigue abierto.", "{X} figura también en el anexo.", "Sobre {X} no hay más datos.", "{X}: pendiente.", "Véase lo dicho de {X}.", "Otra vez {X}.", "Respecto de {X}, se verá luego.", "Falta el informe de {X}.", "También {X} fue objeto de la revisión.", "The note mentions {X} twice.", "More about {X} follows.", "A nota menciona {X} duas vezes.", "Lo de {X} quedó para otro día.", "Hay dos hojas sobre {X}.", "{X}, según el acta.", "Se habló de {X} y de nada más.",
]
#: Openings before and endings after a person, a place or a body; composed freely.
BEFORE_NAME = [
    "Le entregué la copia a ", "Hablé por teléfono con ", "Recibí la carta de ", "Mi vecina ", "El profesor ", "La enfermera ", "Firmado: ", "Atendió: ", "Nombre completo: ", "Solicitante: ", "Responsable: ", "Paciente: ", "Alumno: ", "Titular de la cuenta: ", "Mi nombre es ", "Me llamo ", "Soy ", "A la atención de ", "Cc: ", "De: ", "Para: ", "Estimado ", "Querida ", "El hijo de ", "La esposa de ", "El abogado de ", "Nuestro contador, ", "El conductor fue ", "Testigo: ", "Reported by ", "Please contact ", "My name is ", "Dear ", "Signed, ", "Assinado por ", "Meu nome é ", "El cheque salió a nombre de ", "Vive con ", "Preguntar por ", "Fue visto con ",
]
AFTER_NAME = [
    " no contestó.", " llamó ayer por la tarde.", " vive solo desde enero.", ", de 45 años, trabaja en el mercado.", " cobró el cheque.", " pidió permiso para faltar.", " nació en 1975.", " (34 años) declaró como testigo.", " y su hermana viajaron.", " me lo contó.", " dejó su bolso.", ", madre de tres niños, reclamó.", " said he was late.", " left a message.", " has not paid yet.", " mora perto daqui.", ".", ".", "", " firmó el recibo.", " renunció al cargo.",
]
BEFORE_PLACE = ["Viajamos a ", "El mercado de ", "El clima en ", "La carretera entre {L} y ", "Los vecinos de ", "La provincia de ", "En {L} y ", "Entre {L}, {L} y ", "señores: En {L} y ", "corresponda: En {L}, ", "Llegaron de ", "El río cruza ", "La ruta a ", "Nací en ", "The road to ", "O mercado de ", "El equipo de ", "El distrito de ", "La fiesta de ", "En "]
AFTER_PLACE = [" está cerrada por obras.", " creció mucho.", " queda al norte.", " tiene dos escuelas.", " produce papa y maíz.", " no tiene agua.", ".", " recibió 20 camiones.", ", al sur del valle, llovió.", " is far away.", " fica longe."]
AFTER_BODY = [" publicó las cifras.", " aprobó el gasto.", " no respondió el oficio.", " observó el proyecto.", " redujo la tasa.", " amplió el plazo.", " informó el avance."]
BODIES_LONG = ["el Banco Central", "el Consejo Directivo", "la Comisión Permanente", "el Ministerio de Economía", "la Dirección General", "el Tribunal Superior", "la Superintendencia Nacional", "Defensoría del Pueblo", "Registros Públicos", "Seguro Social", "Fuerza Aérea", "Policía Nacional", "World Bank", "Banco Mundial", "Naciones Unidas", "Unión Europea", "Marco Macroeconómico Multianual", "Tribunal Constitucional", "Corte Suprema", "Contraloría General", "Consejo Fiscal", "Junta Nacional", "Sistema Nacional", "Cámara Alta", "Supreme Court", "Federal Reserve", "Câmara Municipal", "Cuenta General", "Estado Peruano", "Poder Ejecutivo", "Fondo Monetario Internacional", "Reserva Federal", "Producto Bruto Interno", "Ley General", "Plan Anual"]
BEFORE_REACH = ["Llame al ", "Mi celular es ", "Número de contacto: ", "Whatsapp ", "Fono: ", "Call me at ", "Phone: ", "Ligue para ", "Telf. ", "tel. ", "También al ", "Marque el ", "Mi número ", "El fax es ", "Reservas al ", "Emergencias: ", "Dial "]
BEFORE_ID = ["Documento N.° ", "DNI ", "D.N.I. ", "Cédula ", "CPF ", "RUC ", "NIT ", "SSN: ", "Carné de extranjería ", "Identificación: ", "ID number ", "Número de documento: ", "My social security number is "]
BEFORE_STREET = ["Vivo en ", "Mi casa queda en ", "Dirección: ", "Domicilio: ", "Enviar a ", "La tienda está en ", "Nos mudamos a ", "I live at ", "Address: ", "Moro na ", "Recoger en "]
HEADINGS = ["I. Antecedentes.", "II. Análisis.", "III. Conclusiones.", "IV. Recomendaciones", "V. Riesgos.", "A. Resumen", "B. Detalle.", "VI. Anexos.", "I. Introducción", "Cuadro N.° {n}. Resumen", "C. Método."]
CODES = ["El expediente N.° {e} sigue en mesa.", "La partida {q}.{n}.{n} subió.", "El código {e} es de la obra.", "Ley N.° {v} del año.", "Resolución {q}-2019 firme.", "Se gastaron S/ {e} en total.", "Hay {e} habitantes.", "Factura {q}-{e}.", "Cuadro {n}: {t} {t} soles.", "Serie {e}-{q} del equipo.", "El proyecto SNIP {e} avanza.", "Oficio N.° {q}-2020.", "Meta {q}: {d} por ciento."]


def _pseudo(r: random.Random) -> str:
    """A word of no language, for contexts that are not known."""
    return "".join(r.choice("bcdfglmnprstvz") + r.choice("aeiou") for _ in range(r.randint(2, 4)))


def _free(r: random.Random) -> str:
    """A pattern composed of an opening and an ending, some of its words unknown."""
    pattern = _composed(r)
    if r.random() < 0.5:
        some = r.choice([0.3, 0.6])
        pattern = re.sub(r"(?<![{\w])[A-Za-zÀ-ÿ][a-zà-ÿ]{2,}(?![}\w])", lambda m: m.group() if r.random() > some else _pseudo(r) if m.group()[0].islower() else _pseudo(r).capitalize() if m.start() == 0 else m.group(), pattern)
    return pattern


def _composed(r: random.Random) -> str:
    k = r.random()
    if k < 0.36:
        return r.choice(BEFORE_NAME) + "{NAME}" + r.choice(AFTER_NAME)
    if k < 0.46:
        return r.choice(BEFORE_PLACE) + "{L}" + r.choice(AFTER_PLACE)
    if k < 0.56:
        return r.choice(["", "", "Ayer ", "Según ", "Como dijo "]) + "{O}" + r.choice(AFTER_BODY)
    if k < 0.72:
        return r.choice(BEFORE_REACH) + "{PHONE}" + r.choice([".", "", " por la tarde.", ", gracias.", " please."])
    if k < 0.80:
        return r.choice(BEFORE_ID) + "{ID}" + r.choice([".", "", ", vigente.", " del titular."])
    if k < 0.83:
        return r.choice(HEADINGS)
    if k < 0.91:
        return r.choice(BEFORE_STREET) + "{ADDRESS}" + r.choice([".", "", ", segundo piso.", " desde marzo."])
    return r.choice(CODES)


def _name(r: random.Random) -> str:
    one = lambda: r.choice(GIVEN) if r.random() < 0.6 else r.choice(OTHER)
    fam = lambda: r.choice(FAMILY) if r.random() < 0.8 else r.choice(["De la Cruz", "Del Valle", "Del Río", "Del Castillo", "de la Torre", "De la Vega"])
    given = one() if r.random() < 0.75 else f"{one()} {one()}"
    k = r.random()
    if k < 0.5:
        n = f"{given} {fam()} {fam()}"
    elif k < 0.75:
        n = f"{given} {fam()}"
    elif k < 0.83:
        n = f"{given[0]}. {fam()}"
    else:
        f = f"{fam()} {fam()}"
        n = f"{f.upper() if r.random() < 0.7 else f}, {given}"
    return n.upper() if r.random() < 0.2 else n


def _ascii(s: str) -> str:
    return s.lower().translate(str.maketrans("áéíóúñü ", "aeiounu."))


def _email(r: random.Random) -> str:
    user = r.choice(["", "."]).join([_ascii(r.choice(GIVEN)), _ascii(r.choice(FAMILY))]) + r.choice(["", "7", "+x", "45"])
    user = user.replace(".", r.choice([".", "_", "-"]))
    host = r.choice(["correo.test", "mail.valle.example", "oficina-norte.invalid", "buzon.example"])
    at = r.choice(["@", "@", "@", "@", " @ ", " (arroba) ", " [at] ", " arroba ", "(at)"])
    if at.strip() in ("(arroba)", "[at]", "arroba") and r.random() < 0.4:
        host = host.replace(".", " punto ")
    e = user + at + host
    return e.upper() if r.random() < 0.1 else e


def _phone(r: random.Random) -> str:
    d = "9" + "".join(r.choices("0123456789", k=8))
    a, b, c = d[:3], d[3:6], d[6:]
    s = r.choice(["{a}{b}{c}", "{a} {b} {c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "+51 {a} {b} {c}", "0051 {a}{b}{c}", "+51 {a} {b} {c}", "S", "(01) {f}-{g}", "01 {f}{g} anexo {h}", "(044) {f}{g}"])
    if s == "S":
        return " ".join(d)
    out = s.format(a=a, b=b, c=c, f=r.randint(200, 799), g=f"{r.randint(0, 9999):04d}", g2=f"{r.randint(0, 9999):04d}", h=r.randint(10, 99))
    return out.replace(" ", "\u00a0") if r.random() < 0.15 else out


def _id(r: random.Random) -> str:
    d = "".join([r.choice("4567"), *r.choices("0123456789", k=7)])
    return r.choice([d, d, f"00{d[:7]}", f"{r.randint(1, 9)}.{d[:3]}.{d[3:6]}.{d[5:8]}", f"{d[:2]}.{d[2:5]}.{d[5:]}", f"{d[:2]} {d[2:5]} {d[5:]}", f"{d}-{r.randint(0, 9)}", f"{d[:3]}-{d[3:5]}-{r.randint(1000, 9999)}", f"{d[:3]}.{d[3:6]}.{d[2:5]}-{r.randint(10, 99)}", f"{r.choice(['10', '20'])}{d}{r.randint(0, 9)}", f"{r.choice(['10', '20'])}{d}{r.randint(0, 9)}"])


def _street_type(r: random.Random) -> str:
    return r.choice(["Av.", "Jr.", "Psje.", "Calle", "calle", "PASAJE", "Avenida", "Jirón", "Pasaje"])


def _address(r: random.Random) -> str:
    s, n = r.choice(STREETS), r.randint(1, 1999)
    k = r.randrange(9)
    if k == 0:
        return f"Mz. {r.choice('ABCDEFGH')} lote {r.randint(1, 40)}, Urb. {s}"
    if k == 1:
        return f"carretera a {r.choice(PLACES)} km {r.randint(1, 60)},{r.randint(0, 9)}"
    if k == 2:
        return f"{_street_type(r)} {s} N.° {n}, dpto. {r.randint(100, 900)}"
    if k == 3:
        return f"{_street_type(r)} {s} s/n, int. {r.randint(1, 30)}"
    if k == 4:
        return f"{n} {r.choice(['Maple', 'River', 'Old Mill', 'Oak'])} {r.choice(['Street', 'Road', 'Avenue'])}"
    if k == 5:
        return f"Rua {s}, {n}"
    a = f"{_street_type(r)} {s} {n}" + (f", {r.choice(PLACES)}" if k == 6 else "")
    return a.upper() if a.startswith("PASAJE") else a


_MAKE = {"NAME": _name, "EMAIL": _email, "PHONE": _phone, "ID": _id, "ADDRESS": _address}


class _Cast:
    """The people and places of one document; most sentences take theirs from it."""

    def __init__(self, r: random.Random):
        self.names, self.places = [_name(r) for _ in range(r.randint(1, 3))], [r.choice(PLACES) for _ in range(2)]
        self.strong: set[str] = set()

    def namesake(self, r: random.Random) -> str:
        """What a body or bridge is called after: a person, now and then of the cast, in capitals like theirs."""
        v = r.choice(self.names)
        if r.random() < 0.3 and "," not in v and not v.isupper():
            return v
        return f"{r.choice(GIVEN)} {r.choice(FAMILY)}"


def _fill(pattern: str, r: random.Random, cast: _Cast | None = None) -> tuple[str, list[tuple[int, int, str]]]:
    cast = cast or _Cast(r)
    out, spans = "", []
    for part in re.split(r"(\{\w+\})", pattern):
        key = part[1:-1] if part.startswith("{") and part.endswith("}") else None
        if key is None:
            out += part
        elif key in _MAKE:
            v = r.choice(cast.names) if key == "NAME" and r.random() < 0.6 else _MAKE[key](r)
            if key == "NAME" and v in cast.names:
                cast.strong.add(v)
            spans.append((len(out), len(out) + len(v), key))
            out += v
        else:
            out += {
                "B": lambda: r.choice(BODIES), "L": lambda: r.choice(cast.places if r.random() < 0.6 else PLACES), "C": lambda: r.choice(PLACES).upper(), "N": lambda: cast.namesake(r), "F": lambda: r.choice(FAMILY), "S": lambda: r.choice(STREETS), "sT": lambda: _street_type(r), "O": lambda: r.choice(BODIES_LONG),
                "n": lambda: str(r.randint(1, 99)), "t": lambda: str(r.randint(100, 999)), "q": lambda: str(r.randint(1000, 9999)), "v": lambda: str(r.randint(10000, 99999)), "e": lambda: str(r.randint(10**7, 10**8 - 1)), "d": lambda: f"{r.randint(0, 40)},{r.randint(0, 9)}",
            }[key]()
    return out, spans


def _weak(r: random.Random, cast: _Cast) -> tuple[str, list[tuple[int, int, str]]]:
    """A sentence that does not tell: its words are a person of the cast that is named elsewhere, or a place."""
    pattern = r.choice(WEAK)
    named = sorted(cast.strong)
    person = bool(named) and r.random() < 0.7
    v = r.choice(named) if person else r.choice(cast.places)
    if person and r.random() < 0.3 and "," not in v and len(v.split()) > 2 and not v.isupper():
        v = " ".join(v.split()[:2] if r.random() < 0.5 else v.split()[-2:])  # part of the name
    if len(v.split()) < 2 or "de" in v.lower().split()[:1]:
        return "No hay más que decir.", []
    a, b = pattern.split("{X}")
    return a + v + b, [(len(a), len(a) + len(v), "NAME")] if person else []


def documents(n: int = 700, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` documents (text, entity spans) of mixed sentences."""
    r = random.Random(seed)
    docs = []
    for _ in range(n):
        text, spans, cast = "", [], _Cast(r)
        caps = r.random() < 0.05
        for _ in range(r.randint(3, 9)):
            k = r.random()
            if caps or k < 0.25:
                pattern = r.choice(PROSE)
            elif k < 0.6:
                pattern = r.choice(ENTITIES)
            elif k < 0.84:
                pattern = _free(r)
            else:
                pattern = None
            s, e = _fill(pattern, r, cast) if pattern else _weak(r, cast)
            if not e and pattern and r.random() < 0.1:  # words out of order
                w = (s + " " + _fill(r.choice(PROSE), r, cast)[0]).split()
                r.shuffle(w)
                s = " ".join(w)
            s = s[0].upper() + s[1:] if not s.startswith(("<", "@")) and not e else s
            if text:
                text += r.choice([" ", " ", "\n", "\n\n"])
            spans += [(a + len(text), b + len(text), k) for a, b, k in e]
            text += s.upper() if caps else s
        docs.append((text, spans))
    return docs
