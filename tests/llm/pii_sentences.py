"""Sentences kept apart from training: written by hand, with names that neither the grammar nor the tables hold. <...> marks a name."""

SENTENCES = """
I met <Maria Schneider> at the fair and she liked the demo.
Please ask <John Smith> about the spare keys.
Our auditor <Priya Raman> found two mistakes in the ledger.
<Kenji Watanabe> translated the manual into Japanese.
The parcel was accepted by <Olumide Adeyemi> at the front door.
Yesterday <Siobhan O'Connor> left before the vote.
We thank <Marie-Claire Dupont> for her patience.
The minutes were taken by <Henrik Sørensen>.
If you see <Gabriela Mendoza>, give her the folder.
<Bogdan Ionescu> and <Tereza Dvořák> share an office.
A note from <Yaw Boateng> was on the desk.
<Nikhil Deshpande> will drive; the others take the train.
Can <Charlotte Whitfield> move the meeting?
In his mail <Arturo Villanueva> asked for a discount.
Dr. <Farah Siddiqui> opened the ward in 2019.
Mrs. <Gwendolyn Ashcroft> returned the form unsigned.
Herr <Ulrich Brandstetter> ist im Urlaub.
Frau <Annegret Kowalczyk> hat angerufen.
Ich treffe <Katharina Vogel> am Bahnhof.
Gestern hat <Dieter Zimmermann> gekündigt.
Madame <Solange Mercier> habite au troisième étage.
Nous avons rencontré <Thibault Garnier> à Lyon.
<Aurélie Fontaine> remplace le directeur.
La directora <Pilar Echeverría> llegó tarde.
Ayer llamó <Rodrigo Cifuentes> desde el hotel.
Gracias a <Consuelo Barrientos> tenemos las fotos.
The keynote goes to <Ngozi Eze>, not to me.
Our neighbour <Eleanor Pemberton> feeds the cat.
For details write to <Anders Lindholm> or wait a week.
The patent lists <Wolfgang Reinhardt> as inventor.
<Jacqueline Van der Meer> scored the first goal.
Prof. <Lakshmi Venkataraman> teaches statistics.
The winner, <Callum MacGregor>, thanked his coach.
Nobody told <Beatrix Holloway> that the gate was locked.
This was painted by <Ilse Van Houten> in spring.
<Tunde Bakare> sold his share to <Grace Oyelaran>.
The landlord, <Vincenzo Moretti>, refused to pay.
Signed: <Penelope Strand>
Contact: <Rashid Al Farsi>
Attendees were <Mirela Stan>, <Goran Petrović> and <Ayodele Ogunleye>.
After lunch <Hugo Lindberg> showed the garden.
Let <Dorothy Kessler> know when the bus leaves.
We will miss <Emmanuel Kiprop> in the choir.
Dear <Rosalind Achterberg>,
Hello <Cornelius>,
Best regards,
<Felicity Braithwaite>
A taxi brought <Samira Benali> to the airport.
She works for <Theodore Blackwood> since May.
It took <Ludmila Sokolova> four hours to climb up.
The letter is addressed to <Winston Abernathy>.
Is <Katya Morozova> still your flatmate?
Invite <Desmond Tully> and his brother.
The coach praised <Freya Halvorsen> for her run.
<Giovanni Lombardi> cooks on Sundays.
Photo by <Hyunwoo Bae>.
Thanks to <Noor Rahimi> the lamp works again.
"""

#: No person stands in these.
PLAIN = """
The Northwind Bakery opens in Lower Saxony next spring.
Quarterly numbers of Redstone Motors are on the intranet.
Fenwick Holdings bought a stake in Bluebird Airlines.
We flew from Kuala Lumpur to Addis Ababa.
Ticket 4471 moved to the backlog of the Falcon project.
Invoice 55-2093-1187 is still unpaid.
The Riverside Hotel has 240 rooms.
Unser Kunde Nordlicht Energie sucht Fahrer.
La société Horizon Bleu recrute.
El banco Monte Claro cerró ayer.
Dear Customer Support,
Kind regards,
The Harvest team
Version 3.20.11 fixes the login page.
Open the Control Panel and choose Network Settings.
The Blue Ridge Trail is closed in winter.
"""


def labelled(text: str = SENTENCES) -> list[tuple[str, set[tuple[int, int, str]]]]:
    out, hold = [], ""
    for line in text.strip().split("\n"):
        line = hold + line
        hold = ""
        if line.endswith("regards,"):
            hold = line + "\n"
            continue
        plain, gold = "", set()
        for i, part in enumerate(line.replace(">", "<").split("<")):
            if i % 2:
                gold.add((len(plain), len(plain) + len(part), "name"))
            plain += part
        out.append((plain, gold))
    return out
