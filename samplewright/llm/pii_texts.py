"""Made-up passages with labelled personal information, for training the tagger.

Names are common first and family names of several countries, or invented by syllables; numbers follow national forms with any digits; addresses
follow national orders with town and postcode on either side. Every passage also holds numbers and names of things that are no places: dates, versions,
tickets, amounts, models, streets without a number, firms and teams.
"""

from __future__ import annotations

import random

FIRST = {
    "en": "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Olivia Liam Emma Noah Aisha Priya Kwame Siobhan Niamh".split(),
    "de": "Peter Sabine Michael Monika Thomas Andrea Andreas Susanne Stefan Claudia Jürgen Birgit Uwe Gabriele Klaus Heike Lukas Leonie Jonas Hannah Björn Käthe Ayşe Mehmet".split(),
    "fr": "Jean Marie Pierre Françoise Michel Monique André Catherine Philippe Nathalie Camille Léa Hugo Chloé Zoé Benoît Jérôme Aurélie Fatima Loïc".split(),
    "es": "José María Antonio Carmen Manuel Josefa Francisco Isabel Juan Ana Lucía Martín Sofía Ángel Begoña Íñigo Ximena Joaquín Núria".split(),
}
LAST = {
    "en": "Smith Jones Williams Brown Taylor Davies Wilson Evans O'Neill O’Brien McDonald MacLeod Patel Khan Nguyen Johnson Miller Anderson Fitzgerald D'Angelo Okafor Singh Clarke Wright Kowalski".split(),
    "de": "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Schäfer Koch Bauer Richter Klein Wolf Schröder Neumann Zimmermann Groß Yılmaz".split(),
    "fr": "Martin Bernard Dubois Thomas Robert Richard Petit Durand Leroy Moreau Dupont Lefèvre Garnier Fontaine Chevalier d'Aubigné L'Hermitte Benali".split(),
    "es": "García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Martín Jiménez Ruiz Hernández Díaz Muñoz Álvarez Romero Ibáñez Echeverría".split(),
}
PARTICLES = {"en": ["van", "de", "St."], "de": ["von", "von der", "zu"], "fr": ["de", "de la", "du"], "es": ["de la", "del", "de"]}
HAN_LAST, HAN_FIRST = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林罗高郑梁谢宋唐许韩冯邓曹", "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀兰霞平刚桂英华文玉红建国小晓志海雪梅婷宇浩欣怡子轩梓涵"
HAN = HAN_LAST + HAN_FIRST
STREETS = {
    "en": (["Baker", "High", "Church", "Victoria", "Park", "Mill", "Queen's", "Maple", "Oak", "Washington", "Lake", "Hill", "Elm", "Sunset", "King George"], ["Street", "St", "St.", "Road", "Rd", "Avenue", "Ave", "Lane", "Drive", "Dr", "Close", "Court", "Way", "Terrace", "Place", "Blvd"]),
    "de": (["Haupt", "Schul", "Garten", "Bahnhof", "Linden", "Berliner ", "Goethe", "Mozart", "Kirch", "Wald", "Ring"], ["straße", "str.", "weg", "allee", "platz", "gasse", "ufer"]),
    "fr": (["rue", "avenue", "boulevard", "place", "chemin", "quai", "impasse"], ["de Rivoli", "Victor Hugo", "de la République", "des Lilas", "du Moulin", "Pasteur", "de l'Église", "Saint-Michel"]),
    "es": (["Calle", "C/", "Avenida", "Avda.", "Plaza", "Paseo", "Camino"], ["Mayor", "de Alcalá", "del Prado", "de la Constitución", "San Juan", "Real", "de Goya", "de las Flores"]),
}
TOWNS = {
    "en": ["London", "Leeds", "Bristol", "York", "Springfield", "Portland", "Austin", "Denver", "Kingston upon Hull", "St Albans"],
    "de": ["Berlin", "Hamburg", "München", "Köln", "Leipzig", "Bad Homburg", "Zürich", "Wien", "Lüneburg"],
    "fr": ["Paris", "Lyon", "Marseille", "Nantes", "Aix-en-Provence", "Saint-Denis", "Besançon"],
    "es": ["Madrid", "Sevilla", "Bilbao", "A Coruña", "Málaga", "Las Palmas", "Cádiz"],
}
HAN_TOWNS, HAN_ROADS = ["北京市朝阳区", "上海市浦东新区", "广州市天河区", "深圳市南山区", "杭州市西湖区", "成都市"], ["建国路", "人民路", "中山大道", "解放街", "长江路", "文一西路"]
# Forms: 9 a digit, A a capital letter, a a small one.
PHONES = "+1 999-999-9999|(999) 999-9999|999-999-9999|999.999.9999|1-800-999-9999|999-999-9999 x999|+44 7999 999999|07999 999999|+44 (0)20 9999 9999|0161 999 9999|+49 30 9999999|030 999999|0151 99999999|+49 (0)89 999999-99|+33 6 99 99 99 99|06 99 99 99 99|06.99.99.99.99|+34 699 999 999|699 99 99 99|91 999 99 99|+86 138 9999 9999|13999999999|010-99999999|+41 44 999 99 99|+91 99999 99999|+81 3-9999-9999|+351 912 999 999".split("|")
IDS = "999-99-9999|999 99 9999|AA 99 99 99 A|AA999999A|99999999A|99999999-A|A-9999999-A|A99999999|9A9999999|C99AA99A9|99 999 999 999|999999999|9 99 99 99 999 999 99|999999199099999999|99999920019999999A|99.999.999-9|999.999.999-99|AAA999999AA9|99/999/99999|AA9999999|A 9999999".split("|")
KIND_OF_ID = {
    "en": ["social security number", "SSN", "passport no.", "passport", "national insurance number", "tax ID", "identity card", "ID number", "NI number"],
    "de": ["Personalausweis", "Ausweisnummer", "Steuer-ID", "Reisepass", "Sozialversicherungsnummer"],
    "fr": ["numéro de sécurité sociale", "passeport", "carte d'identité n°", "numéro fiscal"],
    "es": ["DNI", "NIE", "NIF", "pasaporte", "número de identidad"],
    "zh": ["身份证号", "护照号码", "证件号", "税号"],
}
# {P} person, {T} telephone, {M} mail, {I} kind of identity and number, {A} address; {N} a number or name of a thing.
FRAMES = {
    "en": ["{P} signed the form on {N}.", "Call {P} on {T} or write to {M}.", "Her {I} was copied into the log.", "Please send the parcel to {A}.", "Reviewed by {P}; {N} was left as it is.", "He lives at {A} and can be reached at {T}.", "Contact: {P}, {A}, Tel {T}", "Tel: {T}, e-mail: {M}", "The new tenant, {P} ({I}), asked about {N}.", "{N} is ready for {P}.", "Ticket {N} was closed, see {N}.", "We met in {N} and looked at {N}.", "From: {P} <{M}>", "Ask {P} or {P} before {N}.", "Ship {N} to {P}, {A}."],
    "de": ["{P} hat am {N} unterschrieben.", "Rückfragen an {P}, Telefon {T}.", "Die {I} steht im Protokoll.", "Bitte an {A} schicken.", "{P} wohnt in der {A}.", "E-Mail {M}, Tel. {T}.", "Ansprechpartner: {P}, {A}", "Vorgang {N} ist erledigt, siehe {N}.", "Frau {P} und Herr {P} prüfen {N}.", "Meine {I}, geboren am {N}."],
    "fr": ["{P} a signé le {N}.", "Contactez {P} au {T}.", "Le {I} figure dans le dossier.", "Adresse : {A}.", "{P} habite au {A}.", "Courriel : {M}, tél. {T}.", "Le lot {N} est prêt, voir {N}.", "M. {P} et Mme {P} ont relu {N}.", "Envoyez {N} à {P}, {A}."],
    "es": ["{P} firmó el {N}.", "Llame a {P} al {T}.", "El {I} consta en la ficha.", "Dirección: {A}.", "{P} vive en {A}.", "Correo {M}, tel. {T}.", "La tarea {N} está lista, véase {N}.", "D. {P} y Dña. {P} revisaron {N}.", "Envíe {N} a {P}, {A}."],
    "zh": ["{P}在{N}签字。", "请联系{P}，电话{T}。", "{I}已写入日志。", "地址：{A}。", "请把{N}寄给{P}，{A}。", "邮箱{M}，手机{T}。", "任务{N}已完成，见{N}。", "{P}和{P}复核了{N}。"],
}
THINGS = "2024-99-19|19.99.2026|99/19/2025|99:99|v9.9.99|9.99.9-rc9|#99999|TCK-99999|batch_999|0.9999|99 %|9,999 rows|EUR 99.99|$ 9,999.99|999 x 999|A-999|ISO 9999|Room 99|9.9.99.999|img_9999.png|99-99|IMG-999-99|order 99999999|999/999|AAA-99-9999|9999-99-99 99:99:99|sha 9a9a99aa99|99 km|99 kg|section 9.9|page 999".split("|")
NAMED = ["the Mill Street set", "Lake View", "Green Hill Archive", "Harbour Road", "North Gallery", "Baker Street", "Maple Court", "the Elm Avenue scenes", "Acme Tools", "Blue River Team", "Night Shift", "Data Quality", "Main Board", "the Church Road batch", "la Plaza Mayor", "der Marktplatz", "Gare du Nord", "Old Town", "East Wing", "Sunset Blvd", "Team Berlin", "Model Zephyr", "Backend Falcon"]


def _fill(form: str, rng: random.Random) -> str:
    return "".join(rng.choice("0123456789") if c == "9" else rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") if c == "A" else rng.choice("abcdef") if c == "a" else c for c in form)


def syllables(rng: random.Random) -> str:
    onset, vowel, coda = "b br c ch d dr f fl g gr h j k kl l m n p pr qu r s sch st t th tr v w y z".split(), "a e i o u ai ei ia ou ö ü é á í ó ä ø".split(), "n r l s t m rd nd ng ck sk th ff x w ń ł".split() + [""] * 6
    return "".join(rng.choice(onset) + rng.choice(vowel) + rng.choice(coda) for _ in range(rng.choice((2, 2, 3)))).capitalize()


def person(lang: str, rng: random.Random) -> str:
    if lang == "zh" and rng.random() < 0.8:
        return rng.choice(HAN_LAST) + "".join(rng.choice(HAN_FIRST) for _ in range(rng.choice((1, 2, 2))))
    lang = lang if lang in FIRST and rng.random() < 0.8 else rng.choice(list(FIRST))
    first = lambda: rng.choice(FIRST[lang]) if rng.random() < 0.75 else syllables(rng)
    last = lambda: rng.choice(LAST[lang]) if rng.random() < 0.7 else rng.choice(("", "", "O'", "Mc", "D'")) + syllables(rng)
    f, s = first() + (f"-{first()}" if rng.random() < 0.1 else ""), last()
    s = f"{s}-{last()}" if rng.random() < 0.08 else f"{s} {last()}" if lang == "es" and rng.random() < 0.35 else f"{rng.choice(PARTICLES[lang])} {s}" if rng.random() < 0.08 else s
    letter = rng.choice("ABCDEFGHIJKLMNOPRSTVW") + "."
    made = rng.choices((f"{f} {s}", f"{s}, {f}", f"{letter} {s}", f"{f} {letter} {s}", f"{letter} {letter} {s}", f"{s} {f}"), (66, 12, 9, 8, 2, 3))[0]
    return made.upper() if rng.random() < 0.04 else made


def address(lang: str, rng: random.Random) -> str:
    number = str(rng.randint(1, 320)) + (rng.choice("aAbB") if rng.random() < 0.1 else "")
    if lang == "zh" and rng.random() < 0.7:
        return rng.choice(HAN_TOWNS) + rng.choice(HAN_ROADS) + f"{rng.randint(1, 400)}号" + (f"{rng.randint(1, 30)}室" if rng.random() < 0.3 else "")
    lang = lang if lang in STREETS and rng.random() < 0.85 else rng.choice(list(STREETS))
    a, b = (rng.choice(x) for x in STREETS[lang])
    if rng.random() < 0.3:
        a, b = (syllables(rng), b) if lang in ("en", "de") else (a, syllables(rng))
    town = rng.choice(TOWNS[lang]) if rng.random() < 0.8 else syllables(rng)
    five, sep = f"{rng.randint(1000, 99999):05d}", rng.choice((", ", ", ", "\n"))
    if lang == "en":
        street = f"{number} {a} {b}"
        flat = rng.random()
        street = f"Flat {rng.randint(1, 40)}, {street}" if flat < 0.1 else f"{street}, {rng.choice(('Apt', 'Unit', 'Suite', '#'))} {rng.randint(1, 90)}" if flat < 0.25 else street
        british = f"{town}{rng.choice((' ', ', '))}" + _fill(rng.choice(("AA9 9AA", "A9 9AA", "AA99 9AA", "A99 9AA")), rng)
        place = rng.choice((british, f"{town}, {rng.choice(('NY', 'CA', 'TX', 'DC', 'OR', 'IL'))} {five}", f"{town} {five}", f"{five} {town}"))
        return f"{street}{sep}{place}" if rng.random() < 0.65 else street
    if lang == "de":
        street = f"{a}{b if not a.endswith(' ') else b.capitalize()} {number}"
        return f"{street}{sep}{rng.choice((f'{five} {town}', f'{town} {five}', f'D-{five} {town}'))}" if rng.random() < 0.65 else street
    street = f"{number}{rng.choice((' ', ', ', ' bis ', ' ter '))}{a} {b}" if lang == "fr" else f"{a} {b}{rng.choice((' ', ', ', ', n.º '))}{number}" + (f", {rng.randint(1, 9)}º {rng.choice('ABCD')}" if rng.random() < 0.2 else "")
    return f"{street}{sep}{rng.choice((f'{five} {town}', f'{five} {town}', f'{town} {five}'))}" if rng.random() < 0.65 else street


def mail(rng: random.Random) -> str:
    lang = rng.choice(list(FIRST))
    plain = lambda w: "".join(c for c in w.lower() if "a" <= c <= "z") or "x"
    f, s = plain(rng.choice(FIRST[lang])), plain(rng.choice(LAST[lang]))
    local = rng.choice((f"{f}.{s}", f"{f}_{s}", f[0] + s, f"{s}{rng.randint(1, 99)}", f"{f}-{s}", f"{f}+{s}", "info", "office.team"))
    domain = [rng.choice(("gmail", "example", "mail", "web", "corp-net", plain(syllables(rng)))), rng.choice(("com", "org", "net", "de", "fr", "es", "co.uk", "io", "cn", "example"))]
    at, dot = rng.choices((("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", ".")), (80, 0, 8, 8, 4))[0]
    return local + at + dot.join(".".join(domain).split("."))


def place(kind: str, rng: random.Random) -> str:
    """A place of a kind in any language."""
    lang = rng.choice(("en", "en", "de", "fr", "es", "zh"))
    if kind == "person":
        return person(lang, rng)
    if kind == "address":
        return address(lang, rng)
    return mail(rng) if kind == "email" else _fill(rng.choice(PHONES if kind == "phone" else IDS), rng)


def passage(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A text of one to six sentences and its places."""
    lang = rng.choice(("en", "en", "de", "fr", "es", "zh"))
    text, spans = "", []

    def put(body: str, kind: str | None = None) -> None:
        nonlocal text
        if kind:
            spans.append((len(text), len(text) + len(body), kind))
        text += body

    for _ in range(rng.randint(1, 6)):
        for piece in rng.choice(FRAMES[lang]).replace("}", "{").split("{"):
            if piece == "P":
                put(person(lang, rng), "person")
            elif piece == "T":
                put(_fill(rng.choice(PHONES), rng), "phone")
            elif piece == "M":
                put(mail(rng), "email")
            elif piece == "A":
                put(address(lang, rng), "address")
            elif piece == "I":
                put(rng.choice(KIND_OF_ID[lang]) + rng.choice((" ", ": ", " ") if lang != "zh" else ("", "：", " ")))
                put(_fill(rng.choice(IDS), rng), "id_number")
            elif piece == "N":
                put(_fill(rng.choice(THINGS), rng) if rng.random() < 0.7 else rng.choice(NAMED))
            else:
                put(piece)
        put(rng.choice((" ", " ", "\n")) if lang != "zh" else rng.choice(("", "\n")))
    return text, spans
