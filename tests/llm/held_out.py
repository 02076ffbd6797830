"""Hand-written sentences for the tagger, with places marked ``<kind:text>``. They serve measurement only: neither the training nor the rules were settled on them."""

import re

SENTENCES = """
The lease was signed by <person:Robert O'Neill> and witnessed by <person:Grace Adeyemi> last Tuesday.
If the boiler fails again, phone <person:Hannah Whitfield> on <phone:020 7946 0958> before noon.
<person:Marcus Bellweather>'s passport <id_number:533380006> expired in March.
You can reach the caretaker at <phone:(415) 555-2671> or <email:caretaker.dean@riversidehomes.org>.
Applicant: <person:Siddharth Rao>, SSN <id_number:123-45-6789>, born 4 May 1988.
Send the samples to <address:742 Evergreen Terrace, Springfield, OR 97403> by courier.
The surgery moved to <address:14 Kingsway, London WC2B 6LH> in autumn.
<person:Lakshmi Venkataraman> lives at <address:88 Bridge Road, Cambridge CB4 3DN>.
Her National Insurance number is <id_number:JG 12 13 16 A>, please keep it private.
Write to <email:m_oconnor77@mailbox.co.uk> or text <phone:+44 7911 123456>.
<person:Tom Baxter>, <person:Ines Ferreira> and <person:K. Lindholm> reviewed 14 frames of the Harbour Road set.
Version 2.14.3 was built on 2025-11-02 and fixed ticket 48213.
The Oak Lane dataset has 3,204 images and 12 classes.
Order 55-201-77 was paid with EUR 1,249.00 at 14:35.
Our mailbox is <email:support-team [at] northwind [dot] io>, answered within 2 days.
<person:Wójcik, Agnieszka> asked for a refund; her number is <phone:+48 601 234 567>.
Bitte rufen Sie <person:Jürgen Großmann> unter <phone:+49 171 2345678> zurück.
Die Praxis von <person:Dorothea Lindqvist> liegt in der <address:Friedrichstraße 43, 10117 Berlin>.
Ausweisnummer <id_number:L01X00T47> wurde am 12.03.2024 erfasst.
<person:Fatma Demir> wohnt jetzt <address:Am Stadtpark 9, 22303 Hamburg>.
Der Vorgang 2023-771 wurde im Team Nord geprüft.
Meine Adresse: <address:Lange Gasse 12, 86152 Augsburg>, Tel. <phone:0821 345678>.
Le dossier de <person:Camille Dupont> est complet depuis hier.
Appelez <person:Guillaume de Villiers> au <phone:06 12 34 56 78> après 18 h.
La patiente habite <address:27 rue des Martyrs, 75009 Paris>.
Numéro de sécurité sociale : <id_number:2 84 05 75 116 123 42>.
Courriel : <email:anne-laure.petit@univ-ouest.fr>, bureau 214.
Le lot 17 contient 860 images de la Place Verte.
<person:María del Carmen Ortega> firmó el contrato el 3 de mayo.
Su DNI es <id_number:47283915K> y su teléfono <phone:612 345 678>.
Vive en <address:Calle de Serrano 85, 28006 Madrid> desde 2019.
Escriba a <email:luis.pena@correo.es> o visite la oficina 12.
La carpeta 2024/118 se cerró con 45 imágenes.
请联系<person:王小明>，电话<phone:13912345678>。
<person:李雪梅>的身份证号是<id_number:110105199003071234>。
快递寄到<address:北京市朝阳区建国路88号>，收件人<person:赵国强>。
共有3204张图片，版本2.1，任务48213。
From: <person:Daniel Achterberg> <email:d.achterberg@postbus.nl>
Emergency contact <person:Yolanda Price>: <phone:1-312-555-0182>.
The courier left it with <person:Miguel Ángel Soto> at <address:5 Harbour View Court, Bristol BS1 5TY>.
Passport <id_number:C01X0006H> and tax ID <id_number:98-7654321> were both on the desk.
Model Falcon-7 scored 0.83 on the Night Shift benchmark.
""".strip().splitlines()

_MARK = re.compile(r"<(email|phone|id_number|address|person):(.*?)>")


def cases():
    """Each text with its set of places ``(start, end, kind)``."""
    for line in SENTENCES:
        text, places, at = "", set(), 0
        for m in _MARK.finditer(line):
            text += line[at : m.start()]
            places.add((len(text), len(text) + len(m[2]), m[1]))
            text, at = text + m[2], m.end()
        yield text + line[at:], places
