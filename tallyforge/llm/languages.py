"""Language of short texts: a character model over words, trained on a few public and everyday lines of each language.

A word's score in a language is the likelihood of its letter groups, of two to four letters with the word's ends, and of the word
itself, smoothed. A text's scores are the sums over its words, so the scores of frequent words are computed once and held. Texts in
another script than the Latin one are told by their letters.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

# fixed values: training lines, for each language the first and second article of the Universal Declaration of Human Rights and one everyday paragraph in translation
LINES = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Everyone is entitled to all the rights and freedoms set forth in this Declaration, without distinction of any kind, such as race, colour, sex, language, religion, political or other opinion. "
    "Good morning, I would like to know whether the train leaves at eight o'clock. If it rains tomorrow, we will stay at home and read. My sister has a small house near the river, where there are many trees. Could you please send me the papers before the end of the week? I did not know that he was ill, otherwise I would have called him. It is too expensive, but perhaps we can find something cheaper. What do you think about it? They have already eaten, so there is nothing left for us. She always says that one must be patient with children. How long have you been here, and which of these books is yours? There were more than ten people who had been waiting since noon. Do not forget to write when you get back.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. Jeder hat Anspruch auf die in dieser Erklärung verkündeten Rechte und Freiheiten ohne irgendeinen Unterschied, etwa nach Rasse, Hautfarbe, Geschlecht, Sprache, Religion, politischer oder sonstiger Überzeugung. "
    "Guten Morgen, ich möchte gern wissen, ob der Zug um acht Uhr abfährt. Wenn es morgen regnet, bleiben wir zu Hause und lesen. Meine Schwester hat ein kleines Haus in der Nähe des Flusses, wo es viele Bäume gibt. Könnten Sie mir bitte die Papiere vor dem Ende der Woche schicken? Ich wusste nicht, dass er krank war, sonst hätte ich ihn angerufen. Es ist zu teuer, aber vielleicht können wir etwas Billigeres finden. Was denken Sie darüber? Sie haben schon gegessen, deshalb ist für uns nichts mehr da. Sie sagt immer, dass man mit Kindern Geduld haben muss. Wie lange sind Sie schon hier, und welches von diesen Büchern gehört Ihnen? Es waren mehr als zehn Leute, die seit Mittag gewartet hatten. Vergiss nicht zu schreiben, sobald du wieder zurück bist.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Chacun peut se prévaloir de tous les droits et de toutes les libertés proclamés dans la présente Déclaration, sans distinction aucune, notamment de race, de couleur, de sexe, de langue, de religion, d'opinion politique ou de toute autre opinion. "
    "Bonjour, je voudrais savoir si le train part à huit heures. S'il pleut demain, nous resterons à la maison et nous lirons. Ma sœur a une petite maison près de la rivière, où il y a beaucoup d'arbres. Pourriez-vous m'envoyer les papiers avant la fin de la semaine, s'il vous plaît ? Je ne savais pas qu'il était malade, sinon je l'aurais appelé. C'est trop cher, mais peut-être pouvons-nous trouver quelque chose de moins cher. Qu'en pensez-vous ? Ils ont déjà mangé, donc il ne reste plus rien pour nous. Elle dit toujours qu'il faut être patient avec les enfants. Depuis combien de temps êtes-vous ici, et lequel de ces livres est à vous ? Il y avait plus de dix personnes qui attendaient depuis midi. N'oublie pas d'écrire dès que tu seras de retour.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Toda persona tiene todos los derechos y libertades proclamados en esta Declaración, sin distinción alguna de raza, color, sexo, idioma, religión, opinión política o de cualquier otra índole. "
    "Buenos días, quisiera saber si el tren sale a las ocho. Si llueve mañana, nos quedaremos en casa y leeremos. Mi hermana tiene una casa pequeña cerca del río, donde hay muchos árboles. ¿Podría usted enviarme los papeles antes del fin de la semana, por favor? No sabía que estaba enfermo, si no, lo habría llamado. Es demasiado caro, pero quizás podamos encontrar algo más barato. ¿Qué piensa usted de eso? Ellos ya han comido, así que no queda nada para nosotros. Ella siempre dice que hay que tener paciencia con los niños. ¿Cuánto tiempo lleva usted aquí, y cuál de estos libros es el suyo? Había más de diez personas que esperaban desde el mediodía. No olvides escribir cuando hayas vuelto.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Ad ogni individuo spettano tutti i diritti e tutte le libertà enunciate nella presente Dichiarazione, senza distinzione alcuna, per ragioni di razza, di colore, di sesso, di lingua, di religione, di opinione politica o di altro genere. "
    "Buongiorno, vorrei sapere se il treno parte alle otto. Se domani piove, resteremo a casa e leggeremo. Mia sorella ha una piccola casa vicino al fiume, dove ci sono molti alberi. Potrebbe mandarmi le carte prima della fine della settimana, per favore? Non sapevo che fosse malato, altrimenti lo avrei chiamato. È troppo caro, ma forse possiamo trovare qualcosa di più economico. Che cosa ne pensa? Hanno già mangiato, quindi non è rimasto niente per noi. Lei dice sempre che bisogna avere pazienza con i bambini. Da quanto tempo è qui, e quale di questi libri è il suo? C'erano più di dieci persone che aspettavano da mezzogiorno. Non dimenticare di scrivere quando sarai tornato.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Todos os seres humanos podem invocar os direitos e as liberdades proclamados na presente Declaração, sem distinção alguma, nomeadamente de raça, de cor, de sexo, de língua, de religião, de opinião política ou outra. "
    "Bom dia, gostaria de saber se o comboio parte às oito horas. Se amanhã chover, ficaremos em casa e leremos. A minha irmã tem uma casa pequena perto do rio, onde há muitas árvores. Poderia enviar-me os papéis antes do fim da semana, por favor? Eu não sabia que ele estava doente, senão ter-lhe-ia telefonado. É muito caro, mas talvez possamos encontrar alguma coisa mais barata. O que acha disso? Eles já comeram, por isso não ficou nada para nós. Ela diz sempre que é preciso ter paciência com as crianças. Há quanto tempo está aqui, e qual destes livros é o seu? Havia mais de dez pessoas que esperavam desde o meio-dia. Não te esqueças de escrever quando tiveres voltado. Você também não vai com a gente.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. Een ieder heeft aanspraak op alle rechten en vrijheden, in deze Verklaring opgesomd, zonder enig onderscheid van welke aard ook, zoals ras, kleur, geslacht, taal, godsdienst, politieke of andere overtuiging. "
    "Goedemorgen, ik zou graag willen weten of de trein om acht uur vertrekt. Als het morgen regent, blijven we thuis en lezen we. Mijn zus heeft een klein huis bij de rivier, waar veel bomen staan. Kunt u mij de papieren voor het einde van de week sturen, alstublieft? Ik wist niet dat hij ziek was, anders had ik hem gebeld. Het is te duur, maar misschien kunnen we iets goedkopers vinden. Wat vindt u daarvan? Zij hebben al gegeten, dus er is niets meer over voor ons. Ze zegt altijd dat je geduld moet hebben met kinderen. Hoe lang bent u hier al, en welk van deze boeken is van u? Er waren meer dan tien mensen die sinds de middag hadden gewacht. Vergeet niet te schrijven wanneer je weer terug bent.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap. Var och en är berättigad till alla de rättigheter och friheter som uttalas i denna förklaring utan åtskillnad av något slag, såsom ras, hudfärg, kön, språk, religion, politisk eller annan uppfattning. "
    "God morgon, jag skulle vilja veta om tåget går klockan åtta. Om det regnar i morgon stannar vi hemma och läser. Min syster har ett litet hus nära floden, där det finns många träd. Kan ni vara snäll och skicka mig papperen före veckans slut? Jag visste inte att han var sjuk, annars hade jag ringt honom. Det är för dyrt, men kanske kan vi hitta något billigare. Vad tycker ni om det? De har redan ätit, så det finns ingenting kvar till oss. Hon säger alltid att man måste ha tålamod med barn. Hur länge har ni varit här, och vilken av de här böckerna är er? Det var fler än tio personer som hade väntat sedan lunch. Glöm inte att skriva när du har kommit tillbaka.",
    "da": "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd. Enhver har krav på alle de rettigheder og friheder, som nævnes i denne erklæring, uden forskelsbehandling af nogen art, for eksempel på grund af race, farve, køn, sprog, religion, politisk eller anden anskuelse. "
    "Godmorgen, jeg vil gerne vide, om toget kører klokken otte. Hvis det regner i morgen, bliver vi hjemme og læser. Min søster har et lille hus tæt på floden, hvor der er mange træer. Kunne De sende mig papirerne inden slutningen af ugen? Jeg vidste ikke, at han var syg, ellers havde jeg ringet til ham. Det er for dyrt, men måske kan vi finde noget billigere. Hvad synes I om det? De har allerede spist, så der er ikke noget tilbage til os. Hun siger altid, at man skal være tålmodig med børn. Hvor længe har I været her, og hvilken af disse bøger er jeres? Der var mere end ti personer, som havde ventet siden middag. Glem ikke at skrive, når du er kommet tilbage.",
    "no": "Alle mennesker er født frie og med samme menneskeverd og menneskerettigheter. De er utstyrt med fornuft og samvittighet og bør handle mot hverandre i brorskapets ånd. Enhver har krav på alle de rettigheter og friheter som er nevnt i denne erklæring, uten forskjell av noen art, for eksempel på grunn av rase, farge, kjønn, språk, religion, politisk eller annen oppfatning. "
    "God morgen, jeg vil gjerne vite om toget går klokka åtte. Hvis det regner i morgen, blir vi hjemme og leser. Søsteren min har et lite hus i nærheten av elva, hvor det er mange trær. Kan dere være så snill å sende meg papirene før slutten av uka? Jeg visste ikke at han var syk, ellers hadde jeg ringt ham. Det er for dyrt, men kanskje vi kan finne noe billigere. Hva synes dere om det? De har allerede spist, så det er ingenting igjen til oss. Hun sier alltid at man må være tålmodig med barn. Hvor lenge har dere vært her, og hvilken av disse bøkene er deres? Det var mer enn ti personer som hadde ventet siden middag. Ikke glem å skrive når du har kommet tilbake.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin tässä julistuksessa esitettyihin oikeuksiin ja vapauksiin ilman minkäänlaista rotuun, väriin, sukupuoleen, kieleen, uskontoon, poliittiseen tai muuhun mielipiteeseen perustuvaa erotusta. "
    "Hyvää huomenta, haluaisin tietää, lähteekö juna kello kahdeksan. Jos huomenna sataa, jäämme kotiin ja luemme. Sisarellani on pieni talo lähellä jokea, missä on paljon puita. Voisitteko lähettää minulle paperit ennen viikon loppua? En tiennyt, että hän oli sairas, muuten olisin soittanut hänelle. Se on liian kallis, mutta ehkä voimme löytää jotain halvempaa. Mitä te ajattelette siitä? He ovat jo syöneet, joten meille ei ole jäänyt mitään. Hän sanoo aina, että lasten kanssa täytyy olla kärsivällinen. Kuinka kauan olette olleet täällä, ja mikä näistä kirjoista on teidän? Paikalla oli yli kymmenen ihmistä, jotka olivat odottaneet keskipäivästä lähtien. Älä unohda kirjoittaa, kun olet palannut.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa i wolności zawarte w niniejszej Deklaracji bez względu na różnice rasy, koloru, płci, języka, wyznania, poglądów politycznych i innych. "
    "Dzień dobry, chciałbym wiedzieć, czy pociąg odjeżdża o ósmej. Jeśli jutro będzie padać, zostaniemy w domu i będziemy czytać. Moja siostra ma mały dom niedaleko rzeki, gdzie jest dużo drzew. Czy mógłby mi pan wysłać papiery przed końcem tygodnia? Nie wiedziałem, że on jest chory, inaczej bym do niego zadzwonił. To jest za drogie, ale może znajdziemy coś tańszego. Co pan o tym myśli? Oni już zjedli, więc nic dla nas nie zostało. Ona zawsze mówi, że trzeba mieć cierpliwość do dzieci. Jak długo państwo już tu są i która z tych książek jest wasza? Było więcej niż dziesięć osób, które czekały od południa. Nie zapomnij napisać, kiedy już wrócisz.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. Každý má všechna práva a všechny svobody, stanovené touto deklarací, bez jakéhokoli rozlišování, zejména podle rasy, barvy, pohlaví, jazyka, náboženství, politického nebo jiného smýšlení. "
    "Dobré ráno, chtěl bych vědět, jestli vlak odjíždí v osm hodin. Jestli bude zítra pršet, zůstaneme doma a budeme číst. Moje sestra má malý dům blízko řeky, kde je mnoho stromů. Mohl byste mi prosím poslat papíry před koncem týdne? Nevěděl jsem, že je nemocný, jinak bych mu zavolal. Je to příliš drahé, ale možná můžeme najít něco levnějšího. Co si o tom myslíte? Oni už jedli, takže na nás nic nezbylo. Ona vždycky říká, že s dětmi musí mít člověk trpělivost. Jak dlouho už jste tady a která z těchto knih je vaše? Bylo tam více než deset lidí, kteří čekali od poledne. Nezapomeň napsat, až se vrátíš.",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității. Fiecare om se poate prevala de toate drepturile și libertățile proclamate în prezenta Declarație fără nici un fel de deosebire, ca de pildă, deosebirea de rasă, culoare, sex, limbă, religie, opinie politică sau orice altă opinie. "
    "Bună dimineața, aș vrea să știu dacă trenul pleacă la ora opt. Dacă mâine plouă, vom rămâne acasă și vom citi. Sora mea are o casă mică lângă râu, unde sunt mulți copaci. Ați putea să-mi trimiteți actele înainte de sfârșitul săptămânii, vă rog? Nu știam că este bolnav, altfel l-aș fi sunat. Este prea scump, dar poate găsim ceva mai ieftin. Ce credeți despre asta? Ei au mâncat deja, așa că nu a mai rămas nimic pentru noi. Ea spune mereu că trebuie să ai răbdare cu copiii. De cât timp sunteți aici și care dintre aceste cărți este a dumneavoastră? Erau mai mult de zece persoane care așteptau de la prânz. Nu uita să scrii când te întorci.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. Mindenki, bármely megkülönböztetésre, nevezetesen fajra, színre, nemre, nyelvre, vallásra, politikai vagy bármely más véleményre való tekintet nélkül hivatkozhat a jelen Nyilatkozatban kinyilvánított összes jogokra és szabadságokra. "
    "Jó reggelt, szeretném tudni, hogy nyolc órakor indul-e a vonat. Ha holnap esik az eső, otthon maradunk és olvasunk. A nővéremnek van egy kis háza a folyó közelében, ahol sok fa van. El tudná küldeni nekem a papírokat a hét vége előtt? Nem tudtam, hogy beteg, különben felhívtam volna. Túl drága, de talán találunk valami olcsóbbat. Mit gondol erről? Ők már ettek, ezért nekünk nem maradt semmi. Mindig azt mondja, hogy a gyerekekkel türelmesnek kell lenni. Mióta vannak itt, és ezek közül melyik könyv az önöké? Több mint tíz ember volt ott, akik dél óta vártak. Ne felejts el írni, ha visszaértél.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. Herkes, ırk, renk, cinsiyet, dil, din, siyasi veya diğer herhangi bir akide farkı gözetilmeksizin bu Beyannamede ilan olunan bütün haklardan ve bütün hürriyetlerden istifade edebilir. "
    "Günaydın, trenin saat sekizde kalkıp kalkmadığını öğrenmek istiyorum. Yarın yağmur yağarsa evde kalıp kitap okuyacağız. Kız kardeşimin nehrin yakınında, çok ağaç olan bir yerde küçük bir evi var. Belgeleri hafta sonundan önce bana gönderebilir misiniz lütfen? Hasta olduğunu bilmiyordum, yoksa onu arardım. Çok pahalı ama belki daha ucuz bir şey bulabiliriz. Bunun hakkında ne düşünüyorsunuz? Onlar zaten yemek yediler, bu yüzden bize hiçbir şey kalmadı. O her zaman çocuklara karşı sabırlı olmak gerektiğini söyler. Ne zamandan beri buradasınız ve bu kitaplardan hangisi sizin? Öğleden beri bekleyen on kişiden fazla insan vardı. Geri döndüğün zaman yazmayı unutma.",
    "id": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan. Setiap orang berhak atas semua hak dan kebebasan yang tercantum di dalam Pernyataan ini tanpa perkecualian apa pun, seperti ras, warna kulit, jenis kelamin, bahasa, agama, politik atau pendapat yang berlainan. "
    "Selamat pagi, saya ingin tahu apakah kereta berangkat jam delapan. Kalau besok hujan, kami akan tinggal di rumah dan membaca. Adik perempuan saya punya rumah kecil di dekat sungai, tempat ada banyak pohon. Bisakah Anda mengirim surat-surat itu kepada saya sebelum akhir minggu? Saya tidak tahu bahwa dia sakit, kalau tahu saya pasti sudah menelepon. Ini terlalu mahal, tetapi mungkin kita bisa menemukan sesuatu yang lebih murah. Bagaimana pendapat Anda tentang itu? Mereka sudah makan, jadi tidak ada yang tersisa untuk kita. Dia selalu berkata bahwa orang harus sabar dengan anak-anak. Sudah berapa lama Anda di sini, dan yang mana dari buku-buku ini milik Anda? Ada lebih dari sepuluh orang yang sudah menunggu sejak siang. Jangan lupa menulis setelah kamu kembali.",
}
#: Letters of scripts with one main language each; where kana stand, Han letters are Japanese.
SCRIPTS = {"ru": "а-яёіїє", "ja": "぀-ヿ", "zh": "一-鿿", "ko": "가-힯", "ar": "؀-ۿ", "he": "֐-׿", "el": "Ͱ-Ͽ", "th": "฀-๿", "hi": "ऀ-ॿ"}

WORD = re.compile(r"[^\W\d_]+")
NON_LATIN = re.compile(f"[{''.join(SCRIPTS.values())}]", re.I)
LATIN = re.compile(r"[a-zà-ɏ]", re.I)
SCRIPT = {k: re.compile(f"[{v}]", re.I) for k, v in SCRIPTS.items()}
SIZES = (2, 3, 4)
HELD_WORDS = 100_000


def _groups(word: str) -> list[str]:
    w = f"_{word}_"
    return [w, *[w[i : i + n] for n in SIZES for i in range(len(w) - n + 1) if len(w) > n]]


class Languages:
    """Log likelihoods of words by language. lines: training text by language code."""

    def __init__(self, lines: dict[str, str] = LINES, smooth: float = 0.05):
        self.codes = sorted(lines)
        at: dict[str, int] = {}
        seen = [[at.setdefault(g, len(at)) for w in WORD.findall(lines[k].lower()) for g in _groups(w)] for k in self.codes]
        counts = np.stack([np.bincount(s, minlength=len(at)) for s in seen]).T.astype(float)
        # how much more than an unseen group each one says for a language
        more = np.log((counts + smooth) / smooth) - np.log(counts.sum(axis=0) + smooth * len(at)) + np.log(counts.sum(axis=0) + smooth * len(at)).mean()
        self.table: dict[str, np.ndarray] = dict(zip(at, more, strict=True))
        self.held: dict[str, np.ndarray] = {}

    def word(self, w: str) -> np.ndarray:
        """Scores of a lower-case word, by language; unseen letter groups speak for none. What is held is bounded."""
        got = self.held.get(w)
        if got is None:
            if len(self.held) >= HELD_WORDS:
                self.held.clear()
            known = [self.table[g] for g in _groups(w) if g in self.table]
            # a word's letter groups overlap, so together they count as some two
            got = self.held[w] = np.sum(known, axis=0) * (2.0 / (len(w) + 1)) if known else np.zeros(len(self.codes))
        return got

    def told(self, text: str) -> tuple[str | None, dict[str, float]]:
        """(most likely language or None, score by language). Each word counts once; words with a capital, often names, are left
        out unless there is little else."""
        if NON_LATIN.search(text):
            hits = {k: len(rx.findall(text)) for k, rx in SCRIPT.items()}
            if hits["ja"]:
                hits["ja"] += hits["zh"]
                hits["zh"] = 0
            top = max(hits, key=lambda k: hits[k])
            if 2 * hits[top] > len(LATIN.findall(text)) or hits[top] >= 8:
                return top, {top: 10.0 * hits[top]}
        words = set(WORD.findall(text))
        seen = sorted(w for w in words if w.islower())
        if len(seen) < 3:
            seen = sorted({w.lower() for w in words})
        if not seen:
            return None, {}
        total = np.add.reduce([self.word(w) for w in seen])
        at = int(total.argmax())
        return self.codes[at], dict(zip(self.codes, total.tolist(), strict=True))


@lru_cache(1)
def trained() -> Languages:
    """One model a worker."""
    return Languages()
