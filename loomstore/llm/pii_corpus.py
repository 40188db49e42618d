"""Generated, labelled training text for the personal-information model.

Sentences are put together from frames: a phrase of everyday correspondence, forms or logs with one place to fill.
People, streets, numbers and code names are coined from syllables; the other words come at random from the vocabulary
of a public tokenizer.  No sentence of a table was taken over and no table is read for fitting.  But the frames
are not blind to the tables: an earlier corpus with such sentences was known when they were written, and they were widened
(dialogues, key=value, Russian words, phone groupings) after the shapes of spans that a first version missed there.

``documents(n, seed, words)`` yields lists of (piece, kind); ``kind`` is '' outside of personal information.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass


@dataclass(frozen=True)
class Words:
    """Words of a public vocabulary: lower-case ones by rank, and those that stand there only with a capital."""

    common: tuple[str, ...]
    proper: tuple[str, ...]


# Some common given names of several languages; half of the generated people have one, the others a coined one.
GIVEN = """
James Mary Robert Linda Michael Susan William Karen Thomas Nancy Daniel Emily Kevin Olivia Brian Rachel Ahmed Leila Wei Priya
Hans Greta Stefan Ursula Jürgen Heike Lukas Sabine Pierre Camille Luc Sylvie Antoine Chloé Javier Lucía Pablo Carmen Diego Marta
João Beatriz Rui Inês Tiago Sofia Lars Ingrid Mateusz Zofia Giulia Marco
""".split()
GIVEN_RU = "Иван Анна Сергей Ольга Дмитрий Елена Павел Мария Андрей Наталья Виктор Светлана Олег Ирина Юрий Татьяна Роман Галина Максим Людмила".split()

_ON = "b br c ch cl d dr f fl g gr h j k kl kr l m n p pl pr qu r s sch sh sk sl sp st t th tr v w z".split() + [""]
_VO = "a a e e i o u ai au ea ei ie ou".split()
_CO = "n r l s m t k x nd rt ck lt ss ng rn ll".split() + ["", "", "", ""]
_FAMILY = "son sen berg stein mann ski ska ova ez es ini elli etti eau ford ton ley well ham wood field er ic escu yan ström lund wald thal dottir enko court ier eira ães ano ino oux ard hart horn quist".split() + ["", "", "a", "o"]
_CODE = "ra ix ex on os ia um ly fy io ent al or is us en el ara ova ium a o e".split() + ["", "", ""]
_ONR = "б в г гр д др ж з к кр л м н п пр р с ст т тр ф х ч ш".split()
_VOR = "а е и о у я ю".split()
_FAMILY_R = "ов ова ев ева ин ина ский ская енко ук юк ян ых ец".split()
_ENDS = "ing ed tion er ment ly s es able ive ous ness ung keit lich en te ge é ée er ant eur ment ción ado ando mente ar ía ção ando ar ência ist ism ity al".split() + [""]
_ENDS_R = "ить ает ного ов ы ам ение ка ках ой ый ся ли ость ать ют ей ую ая ого ем ами ять ет ки на ть но ал ила ен ана".split()
_TOWN = "ton ville burg stadt dorf hausen bridge port mouth haven ford field dale wick stead heim au a o y e mont court".split() + ["", ""]

_PERSON = """
_ joined the call late|we hired _ in spring|many thanks to _ for the {w}|spoke with _ yesterday about the {w}|the account belongs to _|dear _,|kind regards, _|sincerely, _|yours truly _|met _ at the conference|her name is _|full name: _|customer: _
employee _ is on leave|approved by _ on Monday|cc: _|from: _|attn: _|Mr. _ called twice|Ms. _ wrote back|Mrs _ moved out|Dr. _ signed the {w}|Prof. _ teaches there|_ and _ share the desk|_ ({w} lead) said no|according to _ the {w} is {w}|the manager, _, agreed
_ will cover the shift|handed over to _|candidate _ has accepted|the user _ forgot the password|talked to _ on the phone|_ lives nearby|_'s laptop was stolen|written by _|please tell _ that the {w} is {w}|_ wants a {w}|{w} by _|forward this to _|_ said the {w} was {w}|_ will {w} the {w}|hi _, the {w} is {w}
remind _ to {w}|the patient _ arrived|tenant: _|our lawyer _|my colleague _ has {w}|I'm _ from the {w} desk|this is _ speaking|a note from _|signature: _|next of kin: _|_ reported that {C} is {w}|_ handles {C}|only _ knows the {w}|{w} for _|_ likes the {w}|_ is responsible for {C}|beneficiary _|named _|ask for _ at the desk
Frau _ hat angerufen|Herr _ ist krank|Rückfragen bitte an _|mein Name ist _|ich heiße _|unterschrieben von _|Ansprechpartner: _|_ übernimmt die Schicht|viele Grüße _|laut _ ist {C} fertig|der Kunde _ wartet|_ hat die {w} geprüft|Termin mit _|von _ bestellt|_ möchte eine {w}
Madame _ a appelé|Monsieur _ est absent|je m'appelle _|signé par _|selon _ la {w} est prête|adressé à _|cordialement, _|le dossier de _|_ a demandé la {w}|réunion avec _|le client _ attend|écrivez à _
la señora _ llamó|el señor _ no vino|me llamo _|firmado por _|según _ la {w} está lista|atentamente, _|a nombre de _|el cliente _ espera|_ pidió la {w}|reunión con _|gracias a _|avisar a _
a senhora _ ligou|o senhor _ saiu|meu nome é _|assinado por _|segundo _ a {w} está pronta|atenciosamente, _|o cliente _ espera|_ pediu a {w}|falar com _
""".strip().replace("\n", "|").split("|")
_PERSON_RU = "звонила _|моё имя _|подписал _|клиент _ ждёт|по словам _ {w} готов|с уважением, _|сотрудник _ в отпуске|встреча с _ перенесена|автор: _|передать _|письмо от _|_ просит {w}|_ пишет, что {w} {w}|договор с _|спасибо, _|получатель: _|_ отвечает за {C}|узнать у _|контакт: _|заявка от _|врач _ принял|разговор с _ о {C}".split("|")
_EMAIL = """
email me at _|my address is _|please reply to _|e-mail: _|sent from _|forwarded to _|login: _|username _|subscribe _ to the {w}|invite _ please|questions go to _|bounce from _|recipient _|cc _|contact _ for the {w}|unsubscribe _|use _ instead|account _ was locked|write an email to _|the inbox _ is full|reach me via _|drop a line to _|_ did not answer|mail: _|from _ to the {w}
schreib an _|E-Mail-Adresse _|Antwort an _|erreichbar unter _|écrire à _|courriel : _|répondre à _|mon adresse est _|escribir a _|correo: _|responder a _|mi correo es _|enviar para _|o meu email é _|контакт _|почта: _|ответ на _|напишите на _|адрес _ не отвечает
""".strip().replace("\n", "|").split("|")
_PHONE = """
call me on _|phone: _|my number is _|tel: _|mobile _|cell _|fax: _|text me at _|dial _ for the {w}|you can reach us at _ until noon|ring _ tomorrow|the hotline is _|her new number: _|voicemail from _|WhatsApp: _|SMS to _|missed call from _|call back _|emergency contact _|home _ or work _|ph _|the caller used _|number on record _|landline _|please phone _ about the {w}|he rang from _|contact number _
ruf mich an: _|Telefon _|Handy: _|erreichbar unter _|Rückruf an _|appelez le _|téléphone : _|portable _|joindre au _|llame al _|teléfono: _|móvil _|mi número es _|ligue para _|telefone _|telemóvel: _|звоните по номеру _|тел. _|мобильный: _|номер _ не отвечает|перезвонить на _
""".strip().replace("\n", "|").split("|")
_ADDRESS = """
my address is _|address: _|send the parcel to _|she lives at _|he moved to _|deliver it to _ please|billing address: _|shipping to _|our office is at _|the flat at _ is empty|resident of _|home: _|mail it to _|meet me at _|registered at _|the house on _ was sold|pick up from _|new address _|invoice address _|visit us at _|return to sender: _|courier goes to _|postal address _|he gave _ as his home|the tenant of _ moved|currently living at _
wohnt in der _|Anschrift: _|Lieferung an _|Adresse _|umgezogen nach _|habite au _|adresse : _|livrer au _|domicilié _|vive en _|dirección: _|enviar a _|domicilio _|mora na _|morada: _|entregar em _|живёт по адресу _|адрес: _|доставить на _|прописан: _|переехала на _|посылку отправьте на _
""".strip().replace("\n", "|").split("|")
# what stands before a number of a person
_ID = """
SSN|SSN:|social security number|social security no.|soc. sec. #|my social is|tax id|tax ID:|TIN|taxpayer number|tax number|passport|passport no.|passport number|passport #|travel document|driver's license|driving licence|driver licence no.|license number|licence|national id|national ID number|ID card|identity card no.|identity number|personal number|NI number|national insurance number|insurance number|citizen number
Sozialversicherungsnummer|Steuer-ID|Steuernummer|Reisepass|Passnummer|Personalausweis|Ausweisnummer|Führerschein|Führerscheinnummer|numéro de sécurité sociale|numéro fiscal|passeport|passeport n°|carte d'identité|permis de conduire|DNI|NIE|NIF|número de la seguridad social|pasaporte|número de pasaporte|carné de conducir|permiso de conducir|cédula|CPF|passaporte|bilhete de identidade|cartão de cidadão|carta de condução
ИНН|СНИЛС|паспорт|номер паспорта|серия и номер|водительское удостоверение|загранпаспорт|личный номер
""".strip().replace("\n", "|").split("|")
_AROUND_ID = "_|he typed _ in the chat|the customer gave _|we store _ in plain text|please remove _ from the {w}|it has _ on it|her _ is known|_ was leaked|copy of _ attached|verified with _|applicant with _|my _|his _ expired|form says _|{w} shows _ twice|mit _ angemeldet|numéro : _|con _ registrado|указан _|в заявке _|_ в документе|_ belongs to the {w}|scan of the _".split("|")
# what stands before a number of a thing
_THING = """
build|ticket|commit|order|invoice|run|job|revision|batch|part no.|serial number|tracking code|epoch|port|checksum|case|issue|request|session|offset|row|block|ISBN|SKU|RFC|version|release|hash|timestamp|range|pages|model|error|code|bug|patch|line|lines|chunk|slot|trace|span|account balance|limit|size|count|total|batch id|order number|reference|ref|shard|id|key|record|document|sensor|device|reading|token|epoch time|PR|change|lot|crate|page|frame|seed|offsets
Auftrag|Rechnung|Zeile|Version|Vorgang|commande|facture|ligne|dossier|pedido|factura|línea|versión|lote|linha|fatura|заказ|счёт|строка|сборка|тикет|версия|запрос|партия
""".strip().replace("\n", "|").split("|")
_AROUND_THING = "_|the {w} {w} _ was {w}|see _|_ failed after {d} seconds|closed _|_ {w} the {w}|between _ and the {w}|we {w} _ twice|{C} reports _|{w} of _|copied _ to {C}|_ in {C}|rerun _ on {C}|the {w} has _|laut _ ist {C} {w}|selon _ la {w}|según _ la {w}|в {C} _|_ готов".split("|")
_PLAIN = """
the {w} {w} {w} the {w}|{C} depends on the {w} {w}|we {w} the {w} and {w} it again|{T} is {w}|the {T} was {w} by {C}|{C} {w} {d} of {d} {w}|if {C} is {w} then {w} the {w}|{C} Avenue is only a code name|the {C} {w} is {w} since {d} days|in {C} the {w} was {w}|{C} and {C} share the {w}|{C} needs {d} {w}|ask {C} for the {w}|{C} prefers {w} {w}|thanks to {C} the {w} is {w}|{C} said that {d} {w} are {w}|according to {C} the {w} {w}|the owner of {T} is the {w} team|owner: {C}|{w}: {T}|contact the {T} team|approved by the {w} board|from: {C}|{C} {w} the {w}|tell {C} to {w}
{C}: {w} {w}, {w} {d}|{w} and {w} are {w} at {d} percent|{T} and {T} stay {w}|meet at {d}:{d} near the {w}|version {d}.{d}.{d} of {C}|{C}@{d}.{d}.{d} is {w}|@{w} wraps {w}_{w}|@{w}.{w} on {w}|import {w} from @{w}/{w}|git clone git@{w}.{w}:{w}/{w}.git|postgres://{w}:{w}@{w}.{w}:{d}/{w}|amqp://{w}:{w}@{w}-{d}.{w}/{w}|mysql://{w}@{w}:{d} is {w}|https://{w}.{w}/{w}/{d}?{w}={d}|ssh {w}@{d}.{d}.{d}.{d}|{w}@{d}.{d}.{d}-beta.{d}|{w} at {w} dot {w}|{d}.{d}.{d}.{d}:{d} answered|{w}_{w}={d}|{w}.{w}({d})|[{w}] {w} {w} at {d} ms
{d}-{d}-{d} {d}:{d} {w} {w}|20{d}-{d}-{d}T{d}:{d}:{d}Z {w}|{d} × {d} {w}, {d} %|{d},{d} {w} in {d} ms|from 0.{d} to 0.{d}|§ {d} {w}|step {d}: {w} the {w}|{d} Avenue of {w}|the road to {C} has {d} {w}|{C} Street is the name of a {w}|box {d} of the {w}|at {d} {w} per {w}|{d} lanes and {d} roads|{w} in the {w} of {C}|a box with {d} {w}|room {d} is {w}
der {N} von {C} ist {w}|{C} hat {d} {N} gelöscht|für {C} gilt die {N}|laut {C} ist die {N} {w}|die {N} ist größer als {d}, die {N} aber {w}|nach {d} Minuten wird {C} geprüft|der {w} {N} und die {N}|ein {N} mit {d} {N} im {N}|wenn {C} {w}, {w} die {N} den {N}|{N} und {N} {w} {w}|l’{w} de {C} dépasse {d}, l’{w} reste {w}|après {d}, d’{w} et l’{w}|quand {d} {w}, l’{w} a {w} la {w}|dès {d} qu’on {w} l’{w}|{w} {d}, {w} {d}, {w}|le {w} à {d}, car l’{w} est {w}|la {w} de {C} est {w}|selon {C} la {w} est {w}|{C} a {w} {d} {w}|pour {C} on a {w} la {w}|la {w} de {C} está {w}|según {C} la {w} {w}|cuando {C} supera {d}|{C} guardó {d} {w}|a {w} de {C} está {w}|segundo {C} a {w}|{C} pediu {d} {w}
""".strip().replace("\n", "|").split("|")
_PLAIN_RU = "{w} {w} {w} {w} {w}|{w} и {w}, но {w} {w}|{C} {w} {w} {w}|новый {w} {w} в {C}|{w} {d} {w}, {w} {w}|что {w}, то {w} {w}|мы {w} {w} и {w} {C}|для {C} {w} {w} {w}|нужно {w} {w} {w} до {d}|{w} {w} для {C}|{C} пишет, что {w} {w}|если {w} больше {d}, {C} ждёт|{w} из {C} и {w}|по словам {C} {w}|{w} {w} {w} за {d} минут|команда {C} {w}|{C} просит {w}|раздел «{w}» и «{w}»|{w}: {C}|отвечает {C}|в {C} осталось {d}".split("|")
# parts that clauses are composed of: who, what is done to a person, how one is reached, what is done with a number, what may follow
_WHO = "he|she|we|they|I|someone|the user|the customer|a client|the caller|the agent|support|my boss|our team|the {w} team|a {w} user|this person|the {w}|one of the clients|a colleague|the new hire|everybody|nobody".split("|")
_DO = "ask|asked|meet|met|call|called|thank|tell|told|invite|invited|inform|visit|brief|pay|paid|notify|consult|see|saw|trust|praise|blame|follow|help|helped|assign it to|reassigned to|hand over to|escalated to|booked by|requested by|raised by|led by|owned by|reported by|decided by|merged by|reviewed with|lunch with|call with|chat with|a talk with|workshop with|feedback from|notes from|question from|complaint from|request from|wait for|on behalf of|appointment for|reminder for|in the name of|together with|copied to|filed by|quoting|says|signed".split("|")
_REACH = "reach|call|ring|dial|text|contact|phone|message|page|try|get hold of|catch|find|fax|answer|notify".split("|")
_WHOM = "me|us|him|her|them|my wife|the office|the {w} desk|the tenant|our {w}|the {w} {w}|the on-call person|the doctor|someone".split("|")
_PREP = "on|at|under|via|with|by|through|over|:|using|from".split("|")
_GAVE = "sent|typed|entered|shared|shows|used|posted|wrote|left|read out|gave|uploaded|quoted|mentioned|confirmed|submitted|lost|changed|stored|copied|repeated|sends|enters|has|needs|forgot|published|asked for|attached|put".split("|")
_THEN = "into the {w}|by {w}|after the {w}|for the {w} {w}|on {d} {w}|with a {w} {w}|before {w}|which is {w}|in the {w}|during the {w}|at the {w} {w}|about the {w}|over the {w}|from the {w}|to the {w}|without {w}|again|yesterday|on Friday|last week|twice|since {w}|and the {w} is {w}|but {w} the {w}|so the {w} {w}|while {C} {w}|if {C} is {w}|because {w} {w}|when {w}|as {w}|within {d} {w}|near the {w}|under {w} {w}|outside of {w}|until {w}|not the {w}|who {w} the {w}|and {w} a {w} {w}|for every {w}".split("|")
_SAYS = "user|assistant|agent|bot|admin|reviewer|operator|Q|A|customer|support|Frage|Antwort|пользователь|ассистент|note|summary|decision|TODO|step {d}|context|question|answer".split("|")
_ASKS = "can {C} {w} the {w}?|does {C} {w} {w}?|why is {C} {w}?|{C} {w} the {w}|should {C} {w} {d} {w}?|is {C} {w}?|please {w} {C}|yes, {C} {w} the {w}|no, {C} is {w}|how many {w} does {C} {w}?|only if {C} {w} {d} {w}|could {C} {w}, or is {C} {w}?|may {C} {w} the {w} of {C}?|will {C} {w} again?|what {w} {C} {w}?".split("|")
_KEYS = {
    "name": "name full_name owner contact author customer employee reporter assignee patient holder manager client".split(),
    "email": "email mail e_mail contact reply_to login user_email from".split(),
    "phone": "phone tel mobile cell fax contact_number callback".split(),
    "idnum": "ssn passport tax_id national_id licence license_no id_card inn social".split(),
    "address": "address street home billing_address ship_to residence".split(),
}
_FLAT = "service port version build checksum zone region retries timeout replicas status queue owner_team product mode shard commit ticket endpoint host level batch limit weight count state source label note name owner contact".split()


class Maker:
    """Random phrases from one generator of random numbers."""

    def __init__(self, seed: int, words: Words):
        self.r = random.Random(seed)
        common = [w for w in words.common if len(w) > 2]
        self.latin = [w for w in common if not re.search("[а-яё]", w)]
        self.cyrillic = [w for w in common if re.search("[а-яё]", w) and len(w) > 3] or ["слово"]
        self.proper = [w for w in words.proper if len(w) > 3 and re.fullmatch("[A-Za-zÀ-ÿ]+", w)]
        # a document has its own words, so that all of the vocabulary is met, some of it again and again
        self.near: list[str] = []

    def one(self, xs):
        return xs[int(self.r.random() * len(xs))]

    def digits(self, n: int) -> str:
        return f"{int(self.r.random() * 10**n):0{n}d}"

    def number(self) -> str:
        return str(self.r.randint(1, 10 ** self.r.randint(1, 5)))

    def stem(self, least: int = 1, most: int = 2) -> str:
        return "".join(self.one(_ON) + self.one(_VO) + self.one(_CO) for _ in range(self.r.randint(least, most)))

    def coined(self) -> str:
        """A code name of a product, a team or a host, or a name that the vocabulary has."""
        x = self.r.random()
        c = self.one(self.proper) if x < 0.1 else (self.stem(1, 3) + self.one(_CODE)).capitalize()
        return c if x < 0.9 else c.upper() if x < 0.93 else c + self.one(["Hub", "DB", "Flow", "-2", "_" + self.one(self.latin)])

    def word(self) -> str:
        if self.r.random() < 0.25:
            return (self.stem(1, 3) + self.one(_ENDS)).lower()
        return self.one(self.near) if self.r.random() < 0.5 else self.one(self.latin) if self.r.random() < 0.4 else self.latin[int(len(self.latin) * self.r.random() ** 3)]

    def russian_word(self) -> str:
        if self.r.random() < 0.35:
            return self.one(self.cyrillic)
        return "".join(self.one(_ONR) + self.one(_VOR) for _ in range(self.r.randint(1, 3))) + self.one(_ONR) + self.one(_ENDS_R)

    def titled(self) -> str:
        """A title of two or three common words."""
        t = [self.one(self.near).capitalize() if self.r.random() < 0.5 else self.one(self.latin).capitalize() for _ in range(self.r.choice((2, 2, 3)))]
        if self.r.random() < 0.25:
            t[0] = self.coined()
        return " ".join(t)

    def family(self) -> str:
        f = (self.stem(1, 2) + self.one(_FAMILY)).capitalize()
        x = self.r.random()
        return f if x < 0.86 else f + "-" + (self.stem(1, 1) + self.one(_FAMILY)).capitalize() if x < 0.94 else self.one(["von ", "van ", "de ", "Mc", "O'"]) + f

    def given(self) -> str:
        return self.one(GIVEN) if self.r.random() < 0.5 else self.one(self.proper) if self.r.random() < 0.3 else (self.stem(1, 2) + self.one(["a", "o", "e", "en", "an", "in", "el", "is", "y", "ine", ""])).capitalize()

    def name(self) -> str:
        g, f, x = self.given(), self.family(), self.r.random()
        if x < 0.66:
            return f"{g} {f}"
        if x < 0.74:
            return f"{g} {self.one('ABCDEFGHIJKLMNOPRSTUVWXYZ')}. {f}"
        if x < 0.78:
            return f"{g} {self.given()} {f}"
        if x < 0.80:
            return f"{g[0]}. {f}" if self.r.random() < 0.3 else f"{g}-{self.given()} {f}"
        if x < 0.91:
            return f"{f}, {g}"
        return f"{g} {f}".upper() if x < 0.96 else f"{f.upper()} {g}"

    def russian(self) -> str:
        g, f = self.one(GIVEN_RU), "".join(self.one(_ONR) + self.one(_VOR) for _ in range(self.r.randint(1, 2))) + self.one(_ONR[:12]) + self.one(_FAMILY_R)
        if self.r.random() < 0.55:
            g = "".join(self.one(_ONR) + self.one(_VOR) for _ in range(2)) + self.one(["", "", "на", "ра", "н", "л", "й", "р"])
        g, f = g.capitalize(), f.capitalize()
        x = self.r.random()
        if x < 0.25:  # another case than the nominative
            bend = lambda w, ends: w[:-1] + self.one(ends) if w[-1] in "аяй" else w + self.one(("а", "у", "ом", "е"))
            g, f = bend(g, ("ы", "е", "у", "ой")), bend(f, ("ой", "у", "ого"))
        if x < 0.7:
            return f"{g} {f}"
        if x < 0.82:
            return f"{f} {g}"
        return f"{g} {self.one(GIVEN_RU)[:4]}{self.one(('ович', 'евич', 'овна', 'евна'))} {f}" if x < 0.92 else f"{g} {f}".upper()

    def email(self) -> str:
        ascii_only = lambda t: re.sub("[^a-z]", "", t.lower()) or "box"
        g, f = ascii_only(self.given()), ascii_only(self.family())
        box = self.one([f"{g}.{f}", f"{g}_{f}", f"{g}-{f}", f"{g[0]}{f}", f"{g[0]}.{f}", f"{f}{self.digits(2)}", f"{f}.{self.digits(4)}", f"{g}+{self.one(self.latin)}".encode("ascii", "ignore").decode(), f"{g}{f}", g, f, f"{self.one(('info', 'office', 'team', 'sales'))}"])
        host = [ascii_only(self.one((self.stem(1, 2), self.coined(), self.one(self.latin), "example", "mail", "post"))), *([ascii_only(self.stem())] if self.r.random() < 0.2 else []), self.one("com org net test example invalid io de fr es ru pt co info".split())]
        at, dot = self.one([("@", "."), ("@", "."), ("@", "."), ("@", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), ("(at)", "."), (" (at) ", "."), ("[at]", "[dot]"), (" @ ", " . "), (" {at} ", " {dot} "), ("<at>", "<dot>"), (" AT ", " DOT "), ("{at}", "{dot}"), (" [at] ", ".")])
        if at != "@" and self.r.random() < 0.2:
            box = box.replace(".", dot)
        out = f"{box}{at}{dot.join(host)}"
        x = self.r.random()
        return out.upper() if x < 0.06 else f"mailto:{out}" if x < 0.09 else out

    def phone(self) -> str:
        d, area = self.digits, self.r.randint(200, 999)
        groups = self.one(((3, 4), (5, 3), (6,), (7,), (2, 2, 2, 2), (4, 4), (5, 2), (3, 3), (3, 2, 2), (6, 2), (4, 3), (4, 2), (3, 3, 2)))
        head = self.one((f"0{d(self.r.randint(1, 4))}", f"0{d(self.r.randint(1, 4))}", f"(0{d(self.r.randint(1, 4))})", f"+{d(2)} {d(self.r.randint(1, 4))}", f"+{d(2)} (0){d(self.r.randint(1, 4))}", f"00{d(2)} {d(3)}"))
        free = head + self.one((" ", "/", "-", " / ", ".", " ")) + self.one((" ", "-", ".", " ")).join(d(g) for g in groups)
        p = free if self.r.random() < 0.35 else self.one(
            [
                f"{area}-{d(3)}-{d(4)}", f"({area}) {d(3)}-{d(4)}", f"{area}.{d(3)}.{d(4)}", f"{area} {d(3)} {d(4)}", f"1-{area}-{d(3)}-{d(4)}", f"+1 {area} {d(3)} {d(4)}", f"+1-{area}-{d(3)}-{d(4)}", f"+1 ({area}) {d(3)}-{d(4)}", f"+1{area}{d(7)}",
                f"0{d(2)}/{d(6)}", f"0{d(3)} {d(6)}", f"0{d(4)}/{d(5)}-{d(2)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(4)} {d(6)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{d(9)}", f"0{d(2)}/{d(4)}-{d(4)}",
                f"+{d(2)} {d(3)} {d(6)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"+{d(2)} (0){d(3)} {d(6)}", f"+{d(2)} (0) {d(2)} {d(4)} {d(3)}", f"+{d(2)} {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+{d(2)}{d(9)}", f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"+{d(2)}-{d(3)}-{d(7)}",
                f"+7 ({d(3)}) {d(3)}-{d(2)}-{d(2)}", f"+7 {d(3)} {d(3)}-{d(2)}-{d(2)}", f"8 ({d(3)}) {d(3)}-{d(2)}-{d(2)}", f"8-{d(3)}-{d(3)}-{d(2)}-{d(2)}", f"00{d(2)} {d(3)} {d(6)}", f"00{d(2)}{d(10)}", f"{d(3)} {d(2)} {d(2)} {d(2)}", f"9{d(2)} {d(3)} {d(3)}", f"+{d(3)} {d(2)} {d(3)} {d(4)}", f"+{d(2)} {d(4)} {d(6)}", f"+{d(2)}{d(3)} {d(6)}", f"+{d(2)} {d(5)} {d(5)}", f"+{d(2)} {d(2)} {d(5)} {d(3)}",
            ]
        )
        return p + self.one([f" ext. {d(3)}", f" x{d(2)}", f" ext {d(4)}"]) if self.r.random() < 0.08 else p

    def shape(self) -> str:
        """Digits and letters as personal numbers have them."""
        d, L = self.digits, self.one("ABCDEFGHJKLMNPRSTVWXYZ")
        M = L + self.one("ABCDEFGHJKLMNPRSTVWXYZ")
        return self.one(
            [
                f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", d(9), f"{d(2)}-{d(7)}", d(11), f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(3)}/{d(3)}/{d(4)}", f"{d(3)}/{d(4)}/{d(4)}", f"{d(3)}/{d(3)}/{d(5)}", f"{L}{d(8)}", f"{L}{d(7)}", f"{M}{d(7)}", f"{M} {d(7)}", f"{M}{d(6)}", f"{M}{d(6)}{L}", f"{M} {d(2)} {d(2)} {d(2)} {L}", f"{d(8)}{L}", f"{d(8)}-{L}", f"{L}-{d(7)}-{L}", f"{L}{d(7)}{L}",
                d(12), d(10), f"{d(4)} {d(6)}", f"{d(2)} {d(2)} {d(6)}", f"{d(3)}-{d(3)}-{d(3)} {d(2)}", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)}", f"{M}{d(3)} {d(5)}", f"{L}{d(3)}-{d(4)}-{d(4)}", f"{d(6)}-{d(4)}", f"{d(4)} {d(4)} {d(4)}", f"{L}{d(2)}{M}{d(5)}", f"{d(2)} {d(6)} {L} {d(3)}",
            ]
        )

    def thing(self) -> str:
        """A number of a thing: any shape, those of personal numbers and phones among them."""
        d = self.digits
        return self.one(
            [
                self.shape(), self.shape(), f"{d(3)}-{d(3)}-{d(4)}", f"{d(4)}-{d(4)}", f"#{d(4)}", f"#{d(6)}", d(4), d(5), d(6), d(8), d(10), d(13), f"v{d(1)}.{d(2)}.{d(1)}", f"{d(1)}.{d(2)}.{d(3)}", f"{d(3)}.{d(2)}.{d(3)}.{d(2)}", f"0.{d(4)}", f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(2)}/{d(2)}/{d(4)}", f"0x{''.join(self.one('0123456789abcdef') for _ in range(8))}",
                "".join(self.one("0123456789abcdef") for _ in range(self.one((7, 8, 12, 40)))), f"{d(8)}-{d(4)}-4{d(3)}-a{d(3)}-{d(12)}", f"{self.stem().upper()[:4]}-{d(4)}", f"{d(2)}-{d(4)}-{d(3)}", f"20{d(2)}-{d(2)}-{d(4)}-{d(2)}", f"{d(3)},{d(3)}", f"{d(1)},{d(3)},{d(3)}", f"{d(3)} {d(3)}", f"{d(3)} {d(3)} {d(4)}", f"{d(4)}..{d(4)}", f"{d(2)}{d(9)}",
            ]
        )

    def address(self) -> str:
        n, d = str(self.r.randint(1, 399)), self.digits
        s = (self.stem(1, 2) + self.one(_TOWN)).capitalize() if self.r.random() < 0.75 else self.one(self.latin).capitalize()
        t = (self.stem(1, 2) + self.one(_TOWN)).capitalize() if self.r.random() < 0.85 else self.one(self.proper)
        way = self.one("Street Street Road Avenue Lane Drive Court Square Terrace Close Way Boulevard St St. Rd Rd. Ave Ave. Ln Dr Blvd Place Crescent Hill Gardens".split())
        unit = self.one(["", "", "", f", Apt {self.r.randint(1, 90)}", f", Apt. {d(1)}{self.one('ABCD')}", f", Suite {d(3)}", f", Unit {d(2)}", f" #{d(2)}", f", Floor {d(1)}"])
        end = self.one(["", f", {t}", f", {t} {d(5)}", f", {t}, {self.one(('CA', 'NY', 'TX', 'WA', 'OH'))} {d(5)}", f", {t} {self.one('BCEGLMNSW')}{d(2)} {d(1)}{self.one('ABDEHJ')}{self.one('LNPQRS')}", f", {d(5)} {t}"])
        low = lambda x: x[0].lower() + x[1:]
        de = self.one([f"{s}straße {n}", f"{s}str. {n}{self.one(('', 'a', 'b'))}", f"{s}weg {n}", f"{s}gasse {n}", f"{s}platz {n}", f"Am {s} {n}", f"{s}allee {n}", f"{s}ring {n}", f"{s}er Straße {n}", f"{s}ufer {n}{self.one('abc')}"])
        fr = self.one([f"{n} rue de {s}", f"{n}, rue {s}", f"{n} bis rue {s}", f"{n} avenue {s}", f"{n}, avenue de la {s}", f"{n} boulevard {s}", f"{n} ter, place {s}", f"{n} bis, chemin {s}", f"{n}, impasse {s}"])
        es = self.one([f"Calle {s} {n}", f"calle de {s}, {n}", f"Avenida {s} {n}", f"Avda. {s}, {n}", f"Plaza {s} {n}", f"C/ {s} {n}, {d(1)}º {self.one('ABCD')}", f"Paseo de {s} {n}", f"Calle {s} {n}, piso {d(1)}"])
        pt = self.one([f"Rua {s} {n}", f"Rua de {s}, {n}", f"Avenida {s}, {n}", f"Travessa {s} {n}", f"Rua {s}, n.º {n}"])
        r = ("".join(self.one(_ONR) + self.one(_VOR) for _ in range(2)) + self.one(("ная", "ская", "вая", "ний", "ова"))).capitalize()
        town_r = ("".join(self.one(_ONR) + self.one(_VOR) for _ in range(2)) + self.one(("во", "ск", "но", "град", "ль"))).capitalize()
        ru = self.one([f"ул. {r}, {n}", f"ул. {r}, д. {n}, кв. {d(2)}", f"улица {r}, дом {n}", f"пр. {r} {n}", f"пер. {r}, {n}", f"{r} ул., д. {n}", f"{n} {r} улица", f"г. {town_r}, ул. {r}, {n}", f"ул. {r}, {n}, кв. {d(2)}"])
        box = self.one([f"PO Box {d(3)}", f"P.O. Box {d(4)}", f"P. O. Box {d(2)}", f"Box {d(4)}", f"Postfach {d(4)}", f"Apartado {d(3)}", f"BP {d(3)}", f"Caixa Postal {d(4)}", f"а/я {d(3)}"]) + self.one([f", {t}", f", {t} {d(5)}", f", {d(5)} {t}"])
        return self.one(
            [
                f"{n} {s} {way}{unit}{end}", f"{n} {s} {way}{unit}{end}", f"{n}{self.one(('', 'A', '-B', '/2'))} {s} {way}{end}", f"{self.one(('Flat', 'Apt', 'Unit', 'Apartment'))} {d(2)}, {n} {s} {way}{end}", f"{n} {low(s)} {way.lower().strip('.')}", f"{de}, {d(5)} {t}", f"{de}, {d(4)} {t}", de, f"{d(5)} {t}, {de}", f"{fr}, {d(5)} {t}", fr, f"{es}, {d(5)} {t}", f"{es}, {t}", f"{pt}, {d(4)}-{d(3)} {t}", pt, ru, ru, box, box,
            ]
        )

    def idnum(self) -> tuple[str, str]:
        return self.one(_ID) + self.one((" ", " ", " ", ": ", " no. ", " is ", " = ", " № ")), self.shape()

    def value(self, kind: str, russian: bool) -> str:
        return (self.russian() if russian else self.name()) if kind == "name" else getattr(self, kind)()

    def fill(self, frame: str, russian: bool) -> str:
        w = self.russian_word if russian else self.word
        make = {"{w}": w, "{N}": lambda: w().capitalize(), "{C}": self.coined, "{T}": self.titled, "{d}": self.number}
        return re.sub(r"\{[wNCTd]\}", lambda m: make[m[0]](), frame)

    def noise(self, russian: bool) -> str:
        """A few words without sense, so that what is inside a span has to speak for itself."""
        return " ".join(self.russian_word() if russian else self.word() for _ in range(self.r.randint(1, 4)))

    def carrier(self, kind: str) -> list[tuple[str, str]]:
        """A sentence with personal information in it."""
        russian = self.r.random() < 0.2
        frames = {"name": _PERSON_RU if russian else _PERSON, "email": _EMAIL, "phone": _PHONE, "idnum": _AROUND_ID, "address": _ADDRESS}[kind]
        frame = self.one(frames)
        x = self.r.random()
        if x < (0.4 if russian else 0.14):
            frame = f"{self.noise(russian)}{self.one((' ', ' ', ': ', ', ', ' - ', ' (', '='))}_"
        elif x < 0.55 and not russian and kind != "address":
            who, gave = self.one(_WHO), self.one(_GAVE)
            frame = {
                "name": lambda: self.one((f"{who} {self.one(_DO)} _", f"{self.one(_DO)} _", f"_ {gave} the {{w}}", f"{who} and _", f"{self.one(_KEYS['name'])}=_")),
                "email": lambda: self.one((f"{self.one(_REACH)} {self.one(_WHOM)} {self.one(_PREP)} _", f"{who} {gave} _", f"{self.one(_KEYS['email'])}=_", f"{who} {self.one(_DO)} _")),
                "phone": lambda: self.one((f"{self.one(_REACH)} {self.one(_WHOM)} {self.one(_PREP)} _", f"{self.one(_REACH)} _", f"{who} {gave} _", f"{self.one(_KEYS['phone'])}=_", f"{who} {self.one(_REACH)} {self.one(_PREP)} _", f"{gave} a {{w}} {self.one(_PREP)} _")),
                "idnum": lambda: self.one((f"{who} {gave} _", f"{gave} _", f"the {{w}} {gave} _", f"{{w}}: _", f"{gave} {self.one(('his', 'her', 'my', 'their', 'the'))} _")),
            }[kind]()
        if self.r.random() < 0.55:
            frame += self.one((" ", " ", " ", ", ", "; ", " - ", " (")) + self.fill(self.one(_THEN), russian)
        out: list[tuple[str, str]] = []
        pieces = self.fill(frame, russian).split("_") if "_" in frame else [frame]
        if "{" in "".join(pieces):
            pieces = [p.replace("{", "(").replace("}", ")") for p in pieces]
        cased = self.r.random() < 0.6
        for k, p in enumerate(pieces):
            if k and not (k > 1 and kind == "idnum"):
                if kind == "idnum":
                    before, v = self.idnum()
                    out += [(before, ""), (v, kind)]
                else:
                    out.append((self.value(kind, russian), kind))
            out.append((p[:1].upper() + p[1:] if cased and not k else p, ""))
        return out + [(self.one((".", ".", ".", "", "!", ";")), "")]

    def plain(self) -> list[tuple[str, str]]:
        """A sentence without any; many hold numbers, capitals or signs that look like some."""
        x, russian = self.r.random(), self.r.random() < 0.2
        if x < 0.27:
            frame = self.one(_AROUND_THING).replace("_", "\0")
            t = self.fill(frame, russian).replace("\0", self.one(_THING) + self.one((" ", " ", ": ", " no. ", "=", " #")) + self.thing())
        elif x < 0.33:
            t = self.fill(self.one(_SAYS) + ": " + self.one(_ASKS), russian)
        elif x < 0.40:
            t = " ".join(self.russian_word() if russian else self.word() for _ in range(self.r.randint(3, 12)))
            if self.r.random() < 0.3:
                t += " " + self.coined()
        else:
            t = self.fill(self.one(_PLAIN_RU if russian else _PLAIN), russian)
        if self.r.random() < 0.5:
            t += self.one((" ", ", ")) + self.fill(self.one(_THEN), russian)
        return [((t[:1].upper() + t[1:] if self.r.random() < 0.7 else t) + self.one((".", ".", ".", "", "!", "?", ";")), "")]

    def record(self) -> list[tuple[str, str]]:
        """``key: value`` fields in one of the usual layouts."""
        json_like = self.r.random() < 0.45
        q = '"' if json_like else ""
        sep = ", " if json_like else self.one(("; ", " | ", "\n", ";", "|", " ", ", "))
        eq = ": " if json_like else "=" if sep in (" ", ", ") else self.one((": ", ":", " : ", "=", ": "))
        out: list[tuple[str, str]] = [("{" if json_like else "", "")]
        for k in range(self.r.randint(3, 7)):
            kind = self.one(list(_KEYS)) if self.r.random() < 0.25 else ""
            key = self.one(_KEYS[kind]) if kind else self.one(_FLAT)
            if kind and self.r.random() < 0.1:
                key = self.word()
            value = self.value(kind, False) if kind and kind != "idnum" else self.shape() if kind else self.one((self.thing, self.coined, self.titled, self.number, self.word, lambda: self.coined().lower() + "-" + self.word(), lambda: self.fill("{C} {w}", False), lambda: self.fill("{w}-{d}", False)))()
            out += [(f"{sep if k else ''}{q}{key}{q}{eq}{q}", ""), (value.replace('"', ""), kind), (q, "")]
        return out + [("}" if json_like else "", "")]

    def document(self) -> list[tuple[str, str]]:
        self.near = [self.one(self.latin) for _ in range(12)]
        if self.r.random() < 0.12:
            return self.cased(self.record())
        out: list[tuple[str, str]] = []
        known: list[str] = []
        sep = self.one([" ", " ", " ", "\n", "\n- "])
        least = 0.0 if self.r.random() < 0.65 else 0.62  # a third of the documents hold none
        for _ in range(self.r.randint(1, 6)):
            x = max(self.r.random(), least)
            if x < 0.42:
                c = self.carrier(self.one(("name", "name", "email", "phone", "idnum", "address")))
                known += [t for t, k in c if k == "name"]
                out += c
            elif known and x < 0.62:
                # a person met before, whole or by the family name only among others: what is far apart helps
                out += [(self.fill(self.one(("later ", "then ", "and ", "the {w} of ", "{w} ", "")), False), ""), (self.one(known), "name"), (self.fill(self.one((" {w} it", " was {w}", " {w} the {w}.", ".")), False), "")]
            else:
                out += self.plain()
            out.append((sep, ""))
        return self.cased(out)

    def cased(self, out: list[tuple[str, str]]) -> list[tuple[str, str]]:
        x = self.r.random()
        if x < 0.05:
            return [(t.upper(), k) for t, k in out]
        if x < 0.11:
            return [(t.title(), k) for t, k in out]
        if x < 0.15:
            return [(t.lower(), k) for t, k in out]
        if x < 0.18:
            return [("".join(c.swapcase() if self.r.random() < 0.12 else c for c in t), k) for t, k in out]
        return out


def openings() -> list[str]:
    """The words before the first open place of every frame with two words or more there."""
    out = []
    for f in [*_PERSON, *_PERSON_RU, *_EMAIL, *_PHONE, *_ADDRESS, *_AROUND_ID, *_AROUND_THING, *_PLAIN, *_PLAIN_RU]:
        head = re.split(r"_|\{", f)[0].strip()
        if len(head.split()) > 1:
            out.append(head)
    return sorted(set(out))


def documents(n: int, seed: int, words: Words) -> Iterator[list[tuple[str, str]]]:
    m = Maker(seed, words)
    for _ in range(n):
        yield m.document()
