"""The small labelled table from which the tagger for personal data is trained.

A row is a sentence with slots; {person}, {phone}, {email}, {id} and {addr} are mentions,
{num} and {cap} are numbers and capitalised names that are none. Slots are filled from
seeded generators, so the table stays small and no name of any corpus is in it. A row
given more than once weighs as much more.
"""

from __future__ import annotations

import random
import re

ROWS = (
    "{person} signed the report.", "{person} signed the memorandum.", "{person} and {person} were relieved of duty.", "{person} signed the memorandum.", "{person} and {person} were relieved of duty.", "{person} testified and left.", "The waiver names {person} and {person} as witnesses.", "The waiver names {person} and {person} as witnesses.", "{person} and {person} were released from service.", "The form lists {person} and {person} as observers.",
    "Meeting held with Ms. {person} about the results.", "Interview held with Mr. {person} on the findings.", "Escort: {person}, {phone}.", "Return the parcel to {addr}.", "Return the form to {addr}.",
    "Revision {num} supersedes part number {part}.", "Issue {num} supersedes part number {part}.", "Edition {num} replaces component number {part}.", "{cap} and {cap} are names of systems.", "{cap} and {cap} are system names.", "As told by {person}, the lock was intact.", "According to {person}, the seal was intact.",
    "Call {phone} after work.", "Call {phone} after hours.", "Call {phone} after hours.", "Call {phone} for help.", "Escort: {person}, {phone}.", "{person} and {person} were relieved of duty.", "Inhaber: {person}, {addr_de}, {idlabel_de} {id_de}.", "The host {num} was moved from segment {num}.", "Package log-viewer@{num} was pinned.", "Channel @{word}-desk was closed.",
    "Questions go to {email}.", "The complaint by {person} was received from {email}.", "See ticket {num} and contract {num}.", "The checksum prefix is {num}.",
    "Deliver to {cap} {num}, Room {num}.", "Deliver to Building {num}, Room {num}.", "The {cap} approves exceptions.", "The Chief {cap} approves exceptions.", "Form {num} replaces form {num}.", "The {cap} Review Board met on {num}.", "The {cap} Board met on {num}.",
    "The point of contact is {person}, reachable at {email} or {phone}.", "Next of kin: {person} ({phone}), {addr}.", "Next of kin: {person} ({phone}), {addr}. The", "According to {person}, the", "Send the sealed copy to {person}, {addr}, or write to {email}.", "Send the sealed copy to {person}, {addr}, or write to {email}.", "Mme {person} a signé le registre.", "Mme {person} a vérifié la liste.", "{person} and {person} were relieved of duty.", "{person} and {person} were moved.",
    "The badge was issued to {person}, {idlabel} {id}.", "The badge was issued to {person}, {idlabel}: {id}.", "A copy bearing {idlabel} {id} was left at {addr}.", "A copy bearing {idlabel}: {id} was left at {addr}.",
    "Dr. {person} ({idlabel} {id}) lives at {addr}.", "Dr. {person} ({idlabel}: {id}) lives at {addr}.", "The visitor gave {phone} and {idlabel} {id} at the gate.", "The visitor gave {phone} and {idlabel}: {id} at the gate.",
    "Submitted by: {person}\nTelephone: {phone}\nMail: {email}\n{addr}", "Owner: {person} | Telephone: {phone} | Mail: {email}", "cc: {email}; {email}", "cc: {email}; {email}", "cc: {email};", "Write to {email} or {email}.", "Mail: {email}\n{addr}\n The {word}", "Mail: {email}\n{addr}\nEach {word}", "{person}, {addr}, {word}", "personnel number {id}, service number {id}", "Contact {person} by {email}, {phone}.",
    "Selon {person}, le sceau est intact.", "Mme {person} a signé le registre.", "M. {person} a signé le procès-verbal.", "Écrire à {email}.", "Rappeler {person} au {phone}.", "Le point de contact est {person}, joignable au {phone} ou {email}.",
    "Le dossier indique {idlabel_fr} {id_fr}.", "Le dossier indique {idlabel_fr}: {id_fr}.", "Adresse : {addr_fr}.", "Titulaire : {person}, {addr_fr}, {idlabel_fr} {id_fr}.", "Titulaire : {person}, {addr_fr}, {idlabel_fr}: {id_fr}.",
    "Laut {person} war das Siegel heil.", "Herr {person} hat das Protokoll gezeichnet.", "Frau {person} hat das Protokoll geprüft.", "Bitte an {email} senden.", "Rückruf an {person} unter {phone}.", "Ansprechpartner ist {person}, erreichbar unter {phone} oder {email}.",
    "Die Akte nennt {idlabel_de} {id_de}.", "Die Akte nennt {idlabel_de}: {id_de}.", "Anschrift: {addr_de}.", "Inhaber: {person}, {addr_de}, {idlabel_de} {id_de}.", "Inhaber: {person}, {addr_de}, {idlabel_de}: {id_de}.",
    "Según {person}, el precinto está intacto.", "La señora {person} firmó el acta.", "El señor {person} firmó el acta.", "Escriba a {email}.", "Llamar a {person} al {phone}.", "El punto de contacto es {person}, teléfono {phone}, correo {email}.",
    "El expediente recoge {idlabel_es} {id_es}.", "El expediente recoge {idlabel_es}: {id_es}.", "Domicilio: {addr_es}.", "Titular: {person}, {addr_es}, {idlabel_es} {id_es}.", "Titular: {person}, {addr_es}, {idlabel_es}: {id_es}.",
    "{code} {num} {cap}\n\nThe senior {word} of the {cap} {place} must {word} the {word} ledger.", "{code} {num} {cap}\n\nDer Leiter muss das {cap} melden.", "Each shared {word} at the {cap} {place} shall be kept in a {word} safe by the {word} clerk, within {num} days of the audit.",
    "The {cap} {place} will test all {word}, {word} and {word} holdings, using form {code}-{num} and a {word} {word}.", "The {word} manager of the {cap} {place} shall review the {word} in accordance with paragraph {num} of Reference (f).",
    "{num}-day links of the {cap} {place} must not copy a {word} {word}.", "Low- and high-impact {word} services of the {cap} {place} must record the {word}, at least every {num} weeks after the storm.",
    "Control: {cap} {word} audit | Owner: {word} planner | Approver: {word} officer | Interval: {num} months | Evidence: {word} and {word} | Remark: test before {word}",
    "The {word} steward and the {word} monitor must jointly sort the {word} for the {cap} {place}, unless the {word} officer agrees in writing.",
    "Chaque {word} est conservé par le greffier dans un délai de {num} jours.", "Il appartient au délégué de sceller le {word} pour le site {cap}.", "Aucun {word} ne peut être transmis sans l'accord du contrôleur.", "Le greffier doit vérifier le {word} pour le site {cap}.",
    "Der Prüfer muss das {cap} innerhalb von {num} Tagen ersetzen.", "Jedes {cap} ist vom {cap} gemäß Absatz {num} zu sperren.", "Ohne Zustimmung darf der {cap} kein {cap} melden.", "Jedes tragbare {cap} ist vom {cap} für den Standort {cap} zu prüfen.", "Der {cap} soll vor Quartalsende jedes {cap} archivieren.",
    "El custodio debe revisar el {word} según el apartado {num}.", "Cada {word} será custodiado por el revisor en la sede {cap}.", "Ningún {word} podrá salir sin permiso del delegado.", "Corresponde al inspector anotar el {word} en un plazo de {num} días.",
)

_FIRST = "Anna Bruno Carla Denis Elena Fabian Gesa Henrik Irina Jonas Kira Louis Marta Nils Olga Pavel Rosa Samir Tilda Ulrik Vera Wanda Xenia Yusuf Zora Bjørn Chloé Iñigo".split()
_A = "bel cor dra fal gim hor jas kel lom mar nov pel quin rath sor tul vor wes zan brin krag stell thorn".split()
_B = "ade burg casse dal enko fors gren hult ini jak kov lund mann nes otti petit rand stad torp ulle vik wald zaro ström gård".split()
_WORDS = "badge ledger camera archive permit sensor router sample visa roster inspection hangar clerk parcel signed annual portable".split()
_PLACES = "outpost depot hub station pipeline fleet annex campus".split()
_CAPS = "Gate Bridge Registry Closure Upgrade Audit Archive Harvest Register Zertifikat Gerät Protokoll Prüfer Leiter Siegel Program Registrar Firmware Activation".split()
_DOMAINS = ("mail.example", "example.org", "office.sample.net", "post.example.edu", "records.invalid", "example.com")


class _Fill:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def d(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def last(self) -> str:
        return (self.r.choice(_A) + self.r.choice(_B)).capitalize()

    def word(self) -> str:
        return self.r.choice(_WORDS)

    def person(self) -> str:
        r, f, s = self.r, self.r.choice(_FIRST), self.last()
        mid = f" {r.choice('ABCDEFGHJKL')}." if r.random() < 0.15 else ""
        x = r.random()
        name = f"{f[0]}. {s}" if x < 0.15 else f"{s}, {f}" if x < 0.3 else f"{f}{mid} {s}"
        if r.random() < 0.12:
            name = name.upper()
        return name.replace(" ", "\n", 1) if r.random() < 0.06 else name

    def email(self) -> str:
        r, f, s, h = self.r, self.r.choice(_FIRST).lower(), self.last().lower(), self.r.choice(_DOMAINS)
        local = r.choice([f"{f}.{s}", f"{f}-{s}", f"{f}+{self.word()}", f"{s}_{f[0]}", f"{f[0]}{s}", f"{s}{self.d(2)}", s])
        x = r.random()
        if x < 0.25:
            at, dot = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" AT ", " DOT "), (" [at] ", "."), (" [at] ", "."), (" (at) ", " (dot) ")])
            return local.replace(".", dot) + at + h.replace(".", dot)
        return f"{local}@{h}".upper() if x < 0.32 else f"{local}@{h}"

    def phone(self) -> str:
        d, r = self.d, self.r
        return r.choice([
            f"+1 {d(3)} 555 01{d(2)}", f"{d(3)}-555-01{d(2)}", f"({d(3)}) 555-01{d(2)}", f"{d(3)}.555.01{d(2)}", f"1{d(3)}55501{d(2)}", f"{d(3)}-555-01{d(2)} ext. {d(2)}", f"+44 1632 960{d(3)}", f"01632 960{d(3)}",
            f"+33 1 99 00 {d(2)} {d(2)}", f"01 99 00 {d(2)} {d(2)}", f"01.99.00.{d(2)}.{d(2)}", f"+33 (0)1 99 00 {d(2)} {d(2)}", f"+49 30 23125{d(3)}", f"0049 30 23125 {d(3)}", f"030 23125 {d(3)}", f"(030) 23125-{d(3)}",
            f"+34 555 {d(3)} {d(3)}", f"0034-555-{d(6)}", f"555 {d(2)} {d(2)} {d(2)}", f"555{d(6)}",
        ])

    def num(self) -> str:
        d = self.d
        return self.r.choice([d(1), d(2), f"{d(2)}.{d(1)}", f"{d(1)}.{d(2)}", f"{d(4)}.{d(2)}", f"{d(2)}.{d(2)}.{d(1)}", f"00{d(8)}", f"{d(4)}-{d(3)}-{d(4)}", d(12), f"{d(3)}-{d(2)}-{d(4)}", f"192.0.2.{d(2)}", f"20{d(2)}-{d(2)}-{d(2)}", f"K{d(7)}", d(3), d(4)])

    def part(self) -> str:
        return self.r.choice("KGW") + self.d(7)

    def id(self) -> str:
        d, r = self.d, self.r
        s = r.choice([f"666-{d(2)}-{d(4)}", f"000 {d(2)} {d(4)}", f"666 {d(2)} {d(4)}", f"{r.choice('XPKCL')}{d(7)}", f"QQ {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"00{d(8)}", f"QQ{d(6)}{r.choice('ABCD')}"])
        return s

    def idlabel(self) -> str:
        return self.r.choice(["SSN", "social security number", "identity number", "national insurance number", "passport", "service number", "personnel number"])

    def id_fr(self) -> str:
        d = self.d
        return f"{self.r.choice('12')} {d(2)} {d(2)} 99 {d(3)} {d(3)} {d(2)}"

    def idlabel_fr(self) -> str:
        return self.r.choice(["NIR", "numéro de sécurité sociale"])

    def id_de(self) -> str:
        return self.r.choice("LMPRT") + self.d(8)

    def idlabel_de(self) -> str:
        return self.r.choice(["Personalausweis Nr.", "Ausweisnummer", "Steuer-ID"])

    def id_es(self) -> str:
        d, c = self.d, self.r.choice("BDFJ")
        return self.r.choice([f"{d(8)}{c}", f"X{d(7)}{c}", f"{d(2)}.{d(3)}.{d(3)}-{c}", f"{d(8)}-{c}"])

    def idlabel_es(self) -> str:
        return self.r.choice(["DNI", "NIE"])

    def town(self) -> str:
        return self.r.choice(["Port " + self.last(), self.last(), self.last() + " " + self.last()])

    def addr(self) -> str:
        r, d = self.r, self.d
        street = f"{r.randint(1, 250)}{r.choice(['', '', '', 'A', 'B'])} " + r.choice([self.last(), "Old " + self.last(), self.last() + "'s"]) + " " + r.choice("Street Lane Road Close Way Drive Avenue Row".split())
        return street + r.choice(["", f", Apt {d(1)}", f", Apt {d(2)}, {self.town()}", f", {self.town()}", f"\n{self.town()} {d(5)}"])

    def addr_fr(self) -> str:
        r = self.r
        return f"{r.randint(1, 250)}{r.choice(['', ',', ' bis'])} {r.choice('rue avenue boulevard chemin allée'.split())} {r.choice(['de la', 'des', 'du', 'du Vieux'])} {self.last()}, {self.d(5)} {self.r.choice([self.last(), self.last() + '-sur-' + self.last()])}"

    def addr_de(self) -> str:
        r = self.r
        return r.choice([self.last() + "straße", self.last() + "weg", "Am " + self.last(), "Alte " + self.last() + "gasse", self.last() + "er Allee"]) + f" {r.randint(1, 250)}{r.choice(['', 'a', 'b'])}, {self.d(5)} " + r.choice([self.last(), "Sankt " + self.last(), self.last() + " am See"])

    def addr_es(self) -> str:
        r = self.r
        return r.choice(["Calle del ", "Calle de ", "Avenida de los ", "Paseo de la ", "Plaza de la ", "Camino del "]) + f"{self.last()} {r.randint(1, 250)}, {self.d(5)} " + r.choice([self.last(), "San " + self.last()])

    def cap(self) -> str:
        r = self.r
        x = r.random()
        return self.last() if x < 0.35 else self.last() + " " + r.choice(_CAPS) if x < 0.55 else r.choice(_CAPS) if x < 0.75 else r.choice(_CAPS) + " " + r.choice(_CAPS) if x < 0.9 else " ".join((self.last(), r.choice(_CAPS), r.choice(_CAPS))).upper()

    def place(self) -> str:
        return self.r.choice(_PLACES)

    def code(self) -> str:
        return self.r.choice("ABC KLM XPD UV QZ RST".split())


MENTIONS = ("part", "person", "phone", "email", "id", "addr", "num", "cap")


def labelled(copies: int = 22, seed: int = 7, together: int = 3) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]): every row ``copies`` times with other fillings,
    ``together`` rows to a text so that mentions also follow other sentences."""
    fill, rows = _Fill(seed), []
    for _ in range(copies):
        for row in ROWS:
            text, marks = "", []
            for part in re.split(r"(\{\w+\})", row):
                if part[:1] == "{":
                    name = part[1:-1]
                    kind = name.split("_")[0]
                    part = getattr(fill, name)()
                    if kind in MENTIONS:
                        marks.append((len(text), len(text) + len(part), "num" if kind == "part" else kind))
                text += part
            rows.append((text, marks))
    fill.r.shuffle(rows)
    out = []
    for i in range(0, len(rows), together):
        text, marks = "", []
        for t, m in rows[i : i + together]:
            text += fill.r.choice(["", " ", " ", " ", "\n", "\n\n"]) if not text or text[-1] in ".:" else fill.r.choice([" ", "\n", "\n", "\n\n"])
            marks += [(len(text) + a, len(text) + b, k) for a, b, k in m]
            text += t
        out.append((text, marks))
    return out
