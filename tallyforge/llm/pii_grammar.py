"""Labelled sentences for the field: general office prose put together from parts, none of it read off a corpus.

A rule is a template whose slots are other rules, lists of words or makers of names, numbers and addresses; a slot of a personal kind
is labelled where it lands. Number formats are composed: country codes, trunk zeros, group lengths and separators are drawn apart.
"""

from __future__ import annotations

import random
import re

# fixed values: names of many places, so that the field sees more than the table's names; tests hold other ones
WORLD_GIVEN = (
    "James Mary Robert Linda Michael Susan David Karen Thomas Nancy Anna Laura Peter Julia Markus Sabine Jürgen Heike Stefan Ute Pierre Camille Luc Amélie Mathieu Élodie Carlos Lucía Javier Carmen Diego Inés Marco Giulia Paolo "
    "Chiara João Beatriz Rui Lars Ingrid Sven Astrid Mikko Aino Piotr Agnieszka Tomasz Jana Milan Zoltán Ivan Olga Dmitri Natalia Ahmed Fatima Omar Leila Yusuf Ayşe Mehmet Deepa Rajesh Anita Sanjay Mei Jun Li Xin Hiroshi Yuki "
    "Sakura Minho Jiwoo Thanh Linh Kwame Amara Chinedu Zanele Thabo Sipho Noa Eitan Keisha Malik Sofia Emma Oliver Lucas Hannah Ravi Imran"
).split()
WORLD_FAMILY = (
    "Johnson Brown Miller Davis Wilson Taylor Clark Lewis Walker Hall Young King Wright Baker Cooper Ward Müller Schmidt Fischer Weber Wagner Becker Hoffmann Koch Richter Klein Dubois Moreau Laurent Lefebvre Girard Rousseau García "
    "Fernández López Sánchez Romero Torres Rossi Bianchi Ferrari Ricci Silva Costa Pereira Almeida Hansen Larsen Nilsson Lindqvist Virtanen Korhonen Nowak Kowalski Novák Horváth Popescu Petrov Ivanova Yılmaz Demir Hassan Haddad "
    "Khan Malik Sharma Patel Gupta Iyer Chen Wang Liu Huang Tanaka Suzuki Sato Kim Park Nguyen Tran Okafor Mensah Abebe Dlamini Cohen Levi Santos Vargas Mwangi Jensen Bakker Peeters Janssen Murphy Byrne Price Marsh Winter Day Brook Ford Lake Summers Rice Wood Rivers Bell Knight Cook Fox Long Small Frost"
).split()
CONSONANTS = "b br c ch cl d dr f fl g gr h j k kl kr l m n p pl pr qu r s sch sh sk sl sp st str t th tr v w wh y z".split()
VOWELS = "a e i o u ai au ea ei ia ie io oa oo ou".split()
CODAS = "b ck d f g l ll m n nd ng nt p r rd rk rn rt s ss st t tt x z".split()

PARTS: dict[str, list[str]] = {
    "did": "approved|rejected|wrote|presented|sent back|asked about|signed|is checking|will join us for|has questions on|left before|is responsible for|handles|drew up|cancelled|paid for|took over|complained about|forgot|reviewed|leads|runs|confirmed|translated|corrected|is on leave during|wants|knows|owns|opened|agreed to|drafted".split("|"),
    "thing": "the contract|the workshop|the budget|our second offer|the annual report|the lunch|this account|the new plan|the migration|both proposals|the visit|the agenda|the slides|the audit|the delivery|the first interview|payroll|the lease|the decision|a refund".split("|"),
    "to": "I met|we spoke to|talk to|please ask|wait for|on behalf of|a message from|the notes of|thanks to|forward this to|it was|as agreed with|I am writing for|copy in|a call with|lunch with|the report by|questions go to|invite|according to|a favour for|you can reach|hand this to|remind|in the opinion of|we hired|send it via|interviews with|feedback from|signed by|speak with|together with|a letter to|check with|we owe|contact|between us and|cc|approved by|for the attention of".split("|"),
    "when": "tomorrow|on {DAY}|last week|before noon|by {DAY}|this morning|after {MONTH}|in {MONTH}|at three|next month|until {DAY}|soon|again|for now".split("|"),
    "because": "so nothing is lost|because time is short|and that settles it|who will decide|which helps|before we go on|if you can|and then close the file|or leave it|who sits upstairs|since the floor is shut|but not today".split("|"),
    "start": "Because|Since|Although|While|After|Before|Once|Unless|Until|Where|Why|Does|Did|Has|Can|Will|Maybe|Perhaps|Only|Even|Also|Then|Now|Yet|But|And|Or|So|With|Without|Within|From|For|In|On|At|By|As|Like|Ask|See|Try|Use|Open|Call|Last|First|Another|Every|Some|Most|Both|That|This|Our|Your|Their|Its|My|The|A|Not|Today|Tomorrow|Here|There|Again|Still|Reply|Offer|Move|Plan|Weil|Wenn|Falls|Bei|Mit|Ohne|Unser|Ihr|Die|Das|Der|Si|Quand|Avec|Sans|Chez|Pour|Le|La|Cuando|Con|Sin|Para|El|Once again|At least".split("|"),
    "prep": "from|to|by|for|with|of|about|without|and|as|than|between|behind|against|after|before|near|under|beside|like|or|via|de|von|mit|für|bei|an|à|avec|pour|par|chez|a|con|para|por|di|da|com|van".split("|"),
    "noun": "note|letter|gift|song|chapter|lamp|kitchen|photo|window|story|ticket to town|walk|dinner|question|talk|paper|garden|chair|coat|picture|drawing|train|meeting|joke|promise|visit|lesson|speech|bicycle|call|list|word|game|vote|desk|key|box|trip|lecture|poem|signature|rule|complaint|loan|seat|class|house|flat|train|choir|idea|idea|record|prize".split("|"),
    "verb": "sings|waits|left|came back|is ill|won|lost|cooks|moved away|teaches|laughed|retired|called|said no|said yes|was born here|has a cold|lives there|went home|passed|painted the door|wrote a book|fixed it|knew|will know|should sign|may come|scored|plays chess|bought bread|arrives late|is right|was wrong|ist krank|kam zu spät|wohnt hier|est parti|a gagné|arrive|llegó|vive aquí|ganó|è qui|chegou".split("|"),
    "DAY": "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split(),
    "MONTH": "January February March April May June July August September October November December".split(),
    "title": "Mr|Mr.|Mrs|Mrs.|Ms|Ms.|Dr|Dr.|Prof.|Herr|Frau|Herr Dr.|Madame|Monsieur|Mme|señor|señora|Sr.|Sra.|Signora|Don".split("|"),
    "hello": "Dear|Hi|Hello|Hey|Good morning|Morning|Hallo|Guten Tag|Liebe|Lieber|Bonjour|Cher|Chère|Hola|Estimado|Estimada|Buenos días|Buenas tardes|Ciao|Welcome".split("|"),
    "bye": "Best|Best regards|Kind regards|Regards|Thanks|Many thanks|Cheers|Sincerely|Yours truly|Warm regards|Thank you|Viele Grüße|Mit freundlichen Grüßen|Beste Grüße|Cordialement|Bien à vous|Saludos|Un saludo|Atentamente|Cordiali saluti".split("|"),
    "body": "I have read your note.|The room is booked.|Could you send the list?|We had to move the date.|Nothing else is needed.|Wir haben Ihre Nachricht bekommen.|Votre message est bien arrivé.|Hemos recibido su mensaje.|It rained all week.|There are two open points.".split("|"),
    "role": "Contact|From|To|Cc|Name|Attn|Manager|Author|Signed|Sender|Owner|Kontakt|Ansprechpartner|Nom|Nombre|Applicant|Attendee".split("|"),
    "mine": "my number is|my mobile is|my direct number:|call|phone|tel.|tel|Telephone:|Phone:|Mobile:|M:|T:|Tel:|Fax:|cell|text|ring|dial|WhatsApp|reach me on|call us at|the hotline is|you can call|Handy|Telefon|unter|téléphone|portable|au|teléfono|móvil|al|numéro|mi número es el|mein Anschluss ist|je suis au".split("|"),
    "idl": "SSN|social security number|social security no.|soc. sec.|passport|passport no.|passport number|travel document|identity card|identity number|ID number|ID card no.|national ID|national identity no.|national insurance number|NI number|NI no.|NINO|tax ID|tax number|taxpayer no.|driving licence|driver's license|licence no.|residence permit no.|Steuer-ID|Ausweisnummer|Reisepass|numéro de sécurité sociale|carte d'identité|DNI|NIE|número de identidad|pasaporte|personal number|citizen ID".split("|"),
    "thingno": "order|invoice|ticket|parcel|parcel number|tracking number|SKU|article|part|part number|serial number|serial|batch|lot|case|case file|room|flight|bug|build|version|commit|run|run id|job|node|host|server|port|address block|receipt|booking|reservation|policy document|purchase order|PO|reference|ref|item|model|chapter|page|figure|table|row|account plan|project code|shelf|container|warehouse slot|batch id|request id|error|log line|step|score|barcode|ISBN|release|patch|meter|counter|checksum|contract file".split("|"),
    "F": (
        "Software|Bank|Airlines|Logistics|Holdings|Insurance|Foods|Motors|Energy|Media|Pharma|Capital|Partners|Consulting|Group|Studios|Studio|Labs|Systems|Networks|Services|Solutions|Technologies|Hotels|Textiles|Optics|Steel|Mining|Freight|Shipping|Marine|"
        "Telecom|Robotics|Analytics|Cloud|Health|Clinics|Publishing|Records|Furniture|Toys|Brewery|Bakery|Farms|Paper|Glass|Chemicals|Plastics|Devices|Instruments|Works|Payments|Mobility|Security|Retail|Stores|Outdoor|Fashion|Design|Games|Inc|Inc.|Ltd|GmbH|AG|LLC|"
        "University|Institute|School|Street Market|Index|Foundation|Museum|Team|Desk|Department|Office|Server|Report|Sheet|Suite|Platform|Index Fund|Edition"
    ).split("|"),
    "place": "New York|San Francisco|Los Angeles|South Africa|New Zealand|Hong Kong|Costa Rica|Buenos Aires|Saint Petersburg|Cape Town|North America|Eastern Europe|Latin America|United Kingdom|United States|Abu Dhabi|Sri Lanka|Rio Grande|Bad Homburg|Le Havre|Den Haag|Las Vegas|Lake Geneva|Central Park|Silicon Valley|Wall Street|High Street|Main Street|Sierra Leone|San Marino|Tel Aviv|Mexico City|Santa Monica|Port Louis|Saudi Arabia|Burkina Faso|Papua New Guinea|Lower Austria|Northern Ireland|West Bengal|Baden Baden|Monte Carlo|Puerto Rico|Phnom Penh|Novi Sad".split("|"),
    "product": "Visual Studio|Power Point|Google Maps|Amazon Prime|Apache Spark|Ruby On Rails|Open Office|Adobe Reader|Black Friday|Annual Report|Quarterly Review|Human Resources|Customer Success|Product Owner|Project Manager|Sales Team|Executive Board|Best Practice|Machine Learning|Data Platform|Terms And Conditions|Privacy Notice|Christmas Party|Happy Birthday|Best Regards|Kind Regards|Thank You|Due Date|Next Steps|Open Points|Action Items|Meeting Room".split("|"),
}

FRAMES = 2 * [
    "{start} {N} {did} {thing}.", "{start} {N} {verb}.", "{start} {N}, {because}", "a {noun} {prep} {N}", "The {noun} {prep} {N} {when}.", "the {noun} {prep} {N}, {because}", "{N} {verb}.", "{N} {verb}, {N} {verb}.", "her {noun} {prep} {N} {verb}", "my {noun}, {N}, {verb}.", "no {noun} {prep} {N}: {body}", "{start} {noun} {prep} {N}.", "{noun}: {N}", "{noun}s {prep} {N} and {N}", "{start} the {noun} {N} {verb} {when}.", "{did} {N}'s {noun}",
] + [
    "{N} {did} {thing}.", "{N} {did} {thing} {when}.", "{to} {N} {when}", "{to} {N}, {because}.", "{to} {N} about {thing}.", "{N}, {because}, {did} {thing}.", "{to} {N}: {because}.", "{N} and {N} {did} {thing}.", "{N} {did} {thing}; {K} {did} {thing}.",
    "{N}'s desk is empty {when}.", "{to} {N} first, {K} {did} {thing}.", "{title} {N} {did} {thing}.", "{to} {title} {N} {when}.", "{title} {N} {did} {thing} {when}, and {K}'s answer is due.", "{N} said: {body}", "\"{body}\" said {N}.", "{N}?", "- {N} {did} {thing}", "* {to} {N} {when}", "{N} is {X} {F}'s manager.",
    "{hello} {N},\n\n{body}", "{hello} {K},\n\n{body}", "{hello} {K}!\n{body}", "{hello} {N}:\n{body}", "{hello} {title} {N},\n{body}", "{hello} {K} and {N},\n{body}", "{hello} {K},", "{hello} {N},", "{body}\n\n{bye},\n{N}", "{body}\n\n{bye},\n{K}", "{body}\n\n{bye}\n{N}", "{body}\n{bye}\n{K}", "{bye},\n{N}\n{X} {F}", "{bye},\n{N}\n{mine} {P}", "{bye}\n{N}\n{P}",
    "{bye},\n{K}\n{E}", "{role}: {N}", "{role}: {N} <{E}>", "{role}: {N}, {E}", "{role}: {N} ({P})", "{N} | {P} | {E}", "{N}, {P}", "{N} - {E}", "{N}; {E}; {P}", "{N} ({E}) {did} {thing}.", "{N} ({P}) {did} {thing}.", "{N}, {A}", "{N} lives at {A}.", "{N}, {idl} {I}, {did} {thing}.", "{N} was born in {MONTH}.",
    "Ich habe mit {N} gesprochen.", "Bitte wenden Sie sich an {N}.", "{N} ist am {DAY} nicht im Büro.", "Laut {N} passt der Termin.", "{title} {N} meldet sich morgen.", "{title} {N} hat unterschrieben.", "Der Bericht kommt von {N}.", "Das weiß {N} besser.", "Für {N} ist ein Platz frei.", "{N} kommt später.", "Fragen Sie {N} nach dem Schlüssel.", "{N} übernimmt das.",
    "J'ai parlé avec {N} hier.", "Adressez-vous à {N} pour la suite.", "{N} est absent jusqu'à lundi.", "{title} {N} a signé.", "Selon {N} tout va bien.", "Il faut demander à {N} demain.", "C'est {N} qui décide.", "Le dossier de {N} est prêt.", "{N} viendra plus tard.", "Merci d'appeler {N} ce soir.",
    "He hablado con {N} hoy.", "Pregunte a {N} por la llave.", "{N} no está en la oficina.", "{title} {N} firma mañana.", "Según {N} todo está bien.", "El informe es de {N}.", "Avise a {N} antes del lunes.", "{N} vendrá más tarde.", "Ho parlato con {N} ieri.", "Falei com {N} ontem.", "Ik sprak met {N}.",
    "{mine} {P}", "{mine} {P}.", "{mine} {P} {when}.", "{mine} {P}, {because}.", "{mine} {P} or {P}.", "{mine} {P} ext. 12.", "{mine} {P} x204", "{P} is the number to call.", "{P}", "{P} ({when})", "Anrufe bitte {mine} {P}.", "Appelez-moi {mine} {P}.", "Llame {mine} {P}.", "The desk ({P}) is open {when}.", "{X} {F}, {P}",
    "{E}", "Write to {E}.", "{body} Mail: {E}", "Please use {E} instead.", "Send {thing} to {E} {when}.", "Schreiben Sie an {E}.", "Écrivez-nous à {E}.", "Escríbanos a {E}.", "<{E}>", "({E})", "[{E}]", "mailto:{E}", "Email: {E}, phone: {P}", "{E} or {E}", "\"{E}\"", "The address {E} bounces.", "e-mail {E}; thanks",
    "{idl} {I}", "{idl}: {I}", "{idl} is {I}.", "Her {idl} is {I}, {because}.", "his {idl} ({I})", "The form shows {idl} {I} {when}.", "{idl}: {I}, {thing}", "Please remove {idl} {I}.", "someone typed {idl} {I} by accident", "{to} {N}, {idl}: {I}.", "{idl} {I} expires in {MONTH}.", "Meine {idl} lautet {I}.", "Mon {idl} est {I}.", "Mi {idl} es {I}.",
    "{A}", "The shop is at {A}.", "Ship it to {A}, {X}.", "He lives at {A} ({X}).", "{A} is closed {when}.", "Meet us at {A}, {because}.", "Our address: {A}, {X}", "Das Büro ist in der {A}.", "Wir sitzen {A}.", "Le bureau est au {A}, {X}.", "Vivimos en {A}.", "Parcels go to {A}.", "From {MONTH} on we are at {A}, {X}, {because}.", "{to} {N} at {A}.",
]
DECOYS = 3 * [
    "{start} {X} {did} {thing}.", "{start} {X} {F} {did} {thing}.", "{to} {X} {F}, {because}", "{to} {X} {F}.", "{did} {thing} for {X} {F}.", "{thing} of {X} {F}", "Subject: {X} {F} and {X}", "{X} {F} and {X} {F} {did} {thing}.", "{start} {X}, {because}", "{X} {F} ({x}) {did} {thing}.", "{X} {F} is new, {X} is not.", "for {X} {F}\n{body}", "{hello} {X} team,\n{body}", "a {noun} {prep} {X} {F}", "The {noun} {prep} {X} {when}.", "the {noun} {prep} {X}, {because}", "{X} {verb}.", "{X} {F} {verb}.", "her {noun} {prep} {X} {verb}", "my {noun}, {X} {F}, {verb}.", "{noun}: {X} {F}", "the {noun} {prep} {place}", "{place} {verb} {when}.", "{start} {noun} {prep} {X}.", "{start} {place} {verb}",
] + [
    "{X} {did} {thing}.", "{X} {F} {did} {thing}.", "{to} {X} {F} {when}.", "firms like {G} {F} or {X} {F}", "{G} {F} {did} {thing}.", "{X} {X} {did} an update {when}.", "the {X} {X} rollout {when}", "the {X} {F} page", "our {X} {X} licence", "the {X} plan and the {X} plan", "a course on {G} starts {when}", "the {G} module {did} {thing}", "{G} version 2 is out {when}", "about {G} and {X}: {because}",
    "install {G} {when}", "{X} is slow, {because}.", "our move from {X} to {G}", "Is {X} ready?", "{X} {num} is out.", "{place} is far.", "the office in {place} {when}", "{product} is due {when}.", "see {product}", "{product}", "The {product} {did} it.", "{DAY} {MONTH} 3", "Next {DAY} {X} {did} {thing}.", "In {MONTH} {X} grew.", "In {MONTH} {X} {num} was split.", "{MONTH} {X} was calm.", "If {X} agrees, go on.", "Two {X} people left.",
    "When {X} {F} calls, wait.", "Neither {X} nor {X} knows.", "With {X} gone, {X} {did} {thing}.", "No {X} today.", "Update: {X} {did} {thing}.", "Re: {X} and {X}", "Subject: {X} {F} offer", "Subject: the {X} question", "Note: {X} {F}", "{body} {X} {F} {did} {thing}.",
    "{hello} team,", "{hello} all,\n{body}", "{hello} everyone,\n{body}", "{hello} {X} team,\n\n{body}", "{hello} {X} {F} team,\n{body}", "{hello} there,\n{body}", "{hello} Sir or Madam,", "{hello} zusammen,", "{hello} à tous,", "{hello} a todos,", "{body}\n\n{bye},\nThe {X} crew", "{body}\n\n{bye}\nYour office team", "{bye},\nCustomer care", "{bye}\nThe back office", "{bye},\n{X} {F}", "{bye},\nSales team", "{bye}\nTeam {X}", "{title} President,",
    "Die Firma {X} {F} ist neu.", "Das Projekt {X} ruht.", "Ihr Team in {X} sucht Leute.", "Unser Angebot an {X} {F} bleibt.", "Die Stelle bei {X} ist frei.", "Am {DAY} beginnt Projekt {X}.", "Le projet {X} avance.", "Notre équipe de {X} attend.", "La société {X} {F} a répondu.", "L'offre de {X} {F} reste.", "El proyecto {X} sigue.", "La empresa {X} {F} contestó.", "Nuestro equipo en {X} espera.", "{DAY} bei {X}", "Guten Tag {X} Team,",
    "{thingno} {num} is late.", "{thingno} {num}", "{thingno} no. {num}", "{thingno}: {num}", "{thingno} #{num} was closed.", "The {thingno} {num} {did} {thing}.", "{thingno} {num} replaces {thingno} {num}.", "see {thingno} {num}, {because}", "{thingno} {code}", "{thingno}: {code}", "{thingno} {code} {when}", "the {thingno} is {code}.", "{thingno} {num} took {n4} ms", "Bestellung {num}", "Rechnung {num} ist offen.", "commande {num}", "facture {num}", "pedido {num}", "factura {num}",
    "It costs {n3}.{n2} or {n4} a month.", "The total is ${n3},{n3}.{n2}.", "Between {n4} and {n4} people came.", "{n4}-{n4} a year", "from {n4}–{n4}", "It is 2{n3}-0{n1}-1{n1} today.", "0{n1}/1{n1}/20{n2}", "{n2}:{n2} o'clock", "10.{n2}.0.{n1} answers", "host 192.168.{n1}.{n2}", "v{n1}.{n2}.{n3}", "{n2}.{n3}.{n4} beta", "{n10}", "{n8} rows in {n6} files", "in {n7} of {n8} cases", "id={n10}", "{n12} bytes", "00000000000000{n10}", "{n2} {n2} {n2} {n2} {n2}", "scores {n1}/{n2}, {n2}/{n3}",
    "the mean is {n3}.{n4} after {n6} runs", "{n6} calls", "{n9}", "{code}", "{n16}", "{n20}", "{n24}", "{n40}", "{body} 000000000000000000000000{n10}", "at {n2} percent", "a ratio of {n2} to {n3}", "{n3} {n3} units",
    "ask @{x} in the chat", "@{x} and @{x}", "{x}@{num}", "package {x}@latest", "{x}@v2 in the file", "the picture {x}@2x.png", "icon@{n1}x.jpg", "a price @ {n2} each", "meet at {x}", "look at {x} dot by dot", "at {x}.{x}/page", "ssh root@{n2}.{n1}.0.{n1}", "see {x}.example.com",
    "We rank {n2} on the {X} Street list.", "{n2} {X} {F} staff", "{n3} High Street shops closed", "the {X} Road show {when}", "{n2} Park visitors", "route {n2} to {X} Lane Market", "Drive {n2} is full.", "a {n2} Way test", "Court {X} is a room name.", "rue means street", "page {n2} of the {X} Street Index", "{n3} Street Market stalls", "team {n2}, {X} Place Index",
    "The {g} is here.", "a {g} of wood", "by {g} and {g}", "every {g} counts {when}", "their {f} was old", "a {f} and a {g}", "some {f} and more", "{body} The {f} {did} {thing}.", "In {f} we trust.", "{G} {n2} is full.", "{Y} {n2} was moved {when}.", "the {Y} {F}", "The {Y} {did} {thing}.", "{MONTH} {Y} {n2} is new.",
]
# numbers and addresses have many forms, so what holds them counts twice
FRAMES += [f for f in FRAMES if re.search(r"\{[PIA]\}", f)]
DECOYS += [d for d in DECOYS if "{num}" in d or "{code}" in d]


class Writer:
    def __init__(self, given: list[str], family: list[str], rng: random.Random):
        self.r, self.given, self.family = rng, given or WORLD_GIVEN, family or WORLD_FAMILY

    def invented(self, most: int = 3) -> str:
        r = self.r
        return "".join(r.choice(CONSONANTS) + r.choice(VOWELS if r.random() < 0.3 else "aeiou") for _ in range(r.randrange(1, most))).capitalize() + r.choice(CONSONANTS) + r.choice("aeiou") + (r.choice(CODAS) if r.random() < 0.6 else "")

    def digits(self, shape: str) -> str:
        return re.sub("[#@]", lambda m: self.r.choice("0123456789" if m[0] == "#" else "ABCDEFGHJKLMNPRSTVWXYZ"), shape)

    def one(self, table: list[str], world: list[str]) -> str:
        """A name of the table, of the world, one with the ending of a table name, or any."""
        r, k = self.r, self.r.random()
        if k < 0.42:
            return r.choice(table)
        if k < 0.64:
            return r.choice(world)
        if k < 0.84:
            end = r.choice(table)[-r.choice((3, 4, 5) if table is self.family else (2, 3)) :].lower()
            return (r.choice(CONSONANTS) + r.choice("aeiou") + (r.choice(CONSONANTS) + r.choice("aeiou") if r.random() < 0.4 else "")).capitalize() + end
        return self.invented()

    def full(self) -> tuple[str, str]:
        r = self.r
        g, f = self.one(self.given, WORLD_GIVEN), self.one(self.family, WORLD_FAMILY)
        middle = "" if (k := r.random()) < 0.75 else f"{r.choice('ABCDEGHJKLMNPRSTVW')}. " if k < 0.85 else r.choice(["van der ", "von ", "de la ", "de ", "van ", "di ", "al ", "bin ", "del ", "da ", "Van ", "De ", "Al ", "Di ", "Van der ", "El "])
        if (k := r.random()) < 0.08:
            f += "-" + self.one(self.family, WORLD_FAMILY)
        elif k < 0.12:
            f = r.choice(["O'", "Mc", "Mac", "D'"]) + f
        elif k < 0.15 and not middle:
            middle = self.one(self.given, WORLD_GIVEN) + " "
        elif k < 0.18:
            g += "-" + self.one(self.given, WORLD_GIVEN)
        s = f"{g} {middle}{f}"
        if (k := r.random()) < 0.09 and (g in self.given or f in self.family) and "." not in s:
            return s.lower(), g.lower()
        return (s.upper(), g.upper()) if k > 0.95 else (s, g)

    def email(self) -> str:
        r = self.r
        g, f, x = self.one(self.given, WORLD_GIVEN).lower(), self.one(self.family, WORLD_FAMILY).lower(), self.invented().lower()
        local = r.choice([f"{g}.{f}", f"{f}.{g}", f"{g}_{f}", f"{f}_{g}", g, f"{g[0]}{f}", f"{g}{r.randrange(1, 99)}", f"{g}-{f}", f"{g}.{f}+{x}", "info", "sales", "office", x])
        host = r.choice(["", "", "mail.", "eu.", "post."]) + self.invented().lower() + r.choice(["", "-" + x]) + r.choice([".com", ".org", ".net", ".de", ".fr", ".co.uk", ".io", ".test", ".example", ".invalid", ".example.com", ".example.org"])
        if r.random() < 0.66:
            s = f"{local}@{host}"
            return s.upper() if r.random() < 0.08 else s
        a = r.choice([" at ", " (at) ", " [at] ", "(at)", "[at]", " {at} ", " @ "])
        dot = "." if a == " @ " else r.choice([" dot ", " (dot) ", " [dot] "]) if a == " at " or r.random() < 0.5 else "."
        return local + a + host.replace(".", dot)

    def groups(self, total: int, low: int = 2, high: int = 4) -> list[int]:
        out: list[int] = []
        while total > 0:
            n = min(total, self.r.randrange(low, high + 1))
            if 0 < total - n < low:
                n = total
            out.append(n)
            total -= n
        return out

    def phone(self) -> str:
        """A country code or trunk zero, an area code with or without brackets, groups with one separator."""
        r = self.r
        if r.random() < 0.4:  # ten digits of the North American plan
            area, three, four = f"{r.randrange(201, 990)}", r.choice(["555", f"{r.randrange(200, 999)}"]), f"{r.randrange(10000):04}"
            sep = r.choice([" ", "-", ".", "-", "–"])
            s = r.choice([f"{area}{sep}{three}{sep}{four}", f"({area}) {three}{sep}{four}", f"{area}{sep}{three}{sep}{four}", f"{area}{three}{four}"])
            return r.choice(["", "", "+1 ", "+1-", "1 ", "1-", "001 ", "+1"]) + s
        sep = r.choice([" ", " ", " ", ".", "-"])
        if r.random() < 0.15:  # five pairs, as in France
            return r.choice(["0", "0", "0", "+33 "]) + self.digits(sep.join(["#", *["##"] * 4]))
        body = [self.digits("#" * n) for n in self.groups(r.randrange(6, 10))]
        area = str(r.randrange(1, 10)) + self.digits("#" * r.randrange(0, 4))
        cc = r.choice(["44", "49", "33", "34", "39", "31", "41", "43", "46", "48", "55", "61", "81", "86", "91", str(r.randrange(20, 1000))])
        head = r.choice([f"+{cc} {area} ", f"+{cc}{sep}{area}{sep}", f"00{cc} {area} ", f"+{cc} (0){area} ", f"+{cc} ({area}) ", f"0{area}{sep}", f"0{area} ", f"(0{area}) ", f"0{area}/", f"00{cc}/{area} ", f"0{area}-", f"+{cc}"])
        if r.random() < 0.12:
            return re.sub(r"[^\d+]", "", head) + "".join(body)
        if r.random() < 0.15 and len(body) > 1:
            return head + body[0] + " " + "".join(body[1:-1]) + "-" + body[-1]
        return head + sep.join(body)

    def idno(self) -> str:
        r = self.r
        if r.random() < 0.45:
            return self.digits(r.choice(["###-##-####", "### ## ####", "@@ ## ## ## @", "@@######@", "@########", "@#######", "@@#######", "########@", "@@@@######@", "###########", "#########", "## ### ### ###", "#### #### ####", "######/####", "###.###.###-##", "@-#######-@", "@###-####-####", "##########"]))
        return self.digits(r.choice(["-", " ", ".", "/"]).join("#" * n for n in self.groups(r.randrange(8, 12), 2, 5)) if r.random() < 0.7 else "@" * r.randrange(1, 5) + "#" * r.randrange(6, 9) + r.choice(["", "@"]))

    def address(self) -> str:
        r = self.r
        n = f"{r.randrange(1, 2000)}" + (r.choice("abcd") if r.random() < 0.12 else "")
        x, y = r.choice([self.invented(), self.one(self.family, WORLD_FAMILY)]), self.invented()
        kind = r.choice("Street St. St Road Rd Rd. Avenue Ave. Ave Lane Ln Drive Dr. Court Ct Boulevard Blvd. Blvd Terrace Way Square Place Close Crescent Quay Row Parkway".split())
        if r.random() < 0.6:
            return f"{n} {x} {y} {kind}" if r.random() < 0.2 else f"{n} {x} {kind}"
        return r.choice([
            f"{n}, rue de {x}", f"{n} rue {x}", f"{n}, avenue de la {x}", f"{n} boulevard {x}", f"{n}, place du {x}", f"calle {x} {n}", f"Calle de {x}, {n}", f"avenida {x} {n}", f"plaza {x} {n}", f"via {x} {n}", f"Via {x}, {n}", f"rua {x} {n}",
            f"{x}straße {n}", f"{x}str. {n}", f"{x}weg {n}", f"{x}gasse {n}", f"{x}platz {n}", f"{x}allee {n}", f"{x}er Straße {n}", f"{x}er Weg {n}",
        ])

    def fill(self, template: str, text: str, gold: set, held: dict) -> str:
        r = self.r
        for part in re.split(r"(\{\w+\})", template):
            kind, slot = None, part[1:-1] if part[:1] == "{" and part[-1:] == "}" else None
            if slot in PARTS:
                choice = r.choice(PARTS[slot])
                if (not text or text[-1] in "\n." or text[-2:] in (". ", "? ")) and r.random() < 0.8:
                    choice = choice[:1].upper() + choice[1:]
                text = self.fill(choice, text, gold, held)
                continue
            if slot == "N":
                part, held["given"] = self.full()
                kind = "name"
            elif slot == "K":
                part, kind = held.get("given") or self.one(self.given, WORLD_GIVEN), "name"
            elif slot == "G":
                part = self.one(self.given, WORLD_GIVEN)
            elif slot == "Y":
                part = r.choice(self.family)
            elif slot in ("g", "f"):
                part = r.choice(self.given if slot == "g" else self.family).lower()
            elif slot in ("E", "P", "I", "A"):
                part, kind = {"E": (self.email, "email"), "P": (self.phone, "phone"), "I": (self.idno, "id_number"), "A": (self.address, "address")}[slot]
                part = part()
            elif slot in ("X", "x"):
                part = self.invented() if r.random() < 0.8 else self.one(self.family, WORLD_FAMILY)
                part = part if slot == "X" else part.lower()
            elif slot == "num":
                part = self.digits(r.choice(["-", ".", " ", "", "/"]).join("#" * n for n in self.groups(r.randrange(4, 12), 2, 5)))
            elif slot == "code":
                part = self.digits(r.choice(["@@@######@", "@@#######", "@@@#####", "@######", "#@@#####", "@@@-####-##", "@@-######"]))
            elif slot and re.fullmatch(r"n\d+", slot):
                part = str(r.randrange(1, 10)) + self.digits("#" * (int(slot[1:]) - 1))
            if kind:
                gold.add((len(text), len(text) + len(part), kind))
            text += part
        return text


def labelled(given: list[str], family: list[str], n: int, seed: int) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """n short texts of one to three templates, some two fifths of them look-alikes."""
    rng = random.Random(seed)
    w, out = Writer(given, family, rng), []
    for _ in range(n):
        text, gold, held = "", set(), {}
        for _ in range(rng.choice([1, 2, 2, 3])):
            if text:
                text += rng.choice([" ", " ", " ", "\n", "\n\n", "\r\n", "\n- "])
            own: set = set()
            start = len(text)
            text = w.fill(rng.choice(DECOYS if rng.random() < 0.42 else FRAMES), text, own, held)
            if not own and rng.random() < 0.08:
                text = text[:start] + text[start:].upper()
            gold |= own
        out.append((text, gold))
    return out
