"""Given names and the short forms people use for them."""

from __future__ import annotations

import unicodedata

# Common given names of many languages, each with its usual short forms; written down from general knowledge.
GIVEN_NAMES = """
Abdulrahman: Abdul
Abigail: Abby Gail
Adam:
Agnes: Aggie
Ahmed:
Aisha:
Albert: Al Bertie
Alexander: Alex Sandy Xander Sasha
Alexandra: Alexa Sandra
Alfred: Alf Alfie
Alice: Allie
Amanda: Mandy
Andrea:
Andrew: Andy Drew
Angela: Angie
Anna: Annie Anya
Anthony: Tony Ant
Archibald: Archie
Arthur: Art Artie
Barbara: Barb Babs
Beatrice: Bea Trixie
Benjamin: Ben Benny
Bernard: Bernie
Bjørn:
Boris: Borya
Brian:
Carlos: Carlitos
Caroline: Carrie Caro
Catherine: Cathy Cate
Charles: Charlie Chuck
Charlotte: Lottie
Chiara:
Christina: Tina Chrissy
Christopher: Chris Kit Topher
Chukwuemeka: Emeka
Claire:
Claudia:
Concepción: Concha Conchita
Cynthia: Cindy
Daniel: Dan Danny
David: Dave Davy
Deborah: Debbie Deb
Dennis: Denny
Diego:
Dmitri: Dima
Donald: Don Donnie
Dorothy: Dot Dottie Dolly
Edith: Edie
Eduardo: Edu Lalo
Edward: Ed Eddie Ned Ted Teddy
Eleanor: Ellie Nell Nora
Elena: Lena
Elizabeth: Liz Beth Betty Eliza Libby Lizzie
Emily: Em
Eric:
Eugene: Gene
Fatima:
Fernando: Nando
Florence: Flo Flossie
Francesca: Fran
Francisco: Paco Pancho Curro
Frederick: Fred Freddie Freddy
Friederike: Rieke Fritzi
Gabriel: Gabe
Geneviève: Ginette Gen
George: Georgie
Gerald: Gerry Jerry
Gertrude: Trudy
Giovanni: Gianni Nino
Giuseppe: Beppe Peppe
Grace: Gracie
Gregory: Greg
Guadalupe: Lupe Lupita
Hannah:
Harold: Hal
Heinrich: Heinz Heiner
Helen: Nellie
Henry: Hank Harry Hal
Hiroshi: Hiro
Humberto: Beto
Ibrahim:
Ignacio: Nacho
Ingrid:
Isabella: Bella Isa Izzy
Ivan: Vanya
Jacob: Jake
Jacqueline: Jackie
James: Jim Jimmy Jamie
Jeffrey: Jeff
Jennifer: Jen Jenny
Jessica: Jess Jessie
Johannes: Hannes Hans
John: Jack Johnny
Jonathan: Jon Jonny
José: Pepe
Joseph: Joe Joey
Joshua: Josh
Juan: Juanito
Judith: Judy
Julia: Jules
Jürgen:
Karen:
Katarzyna: Kasia
Katherine: Kate Kathy Katie Kitty
Kenneth: Ken Kenny
Kimberly: Kim
Klaus:
Lakshmi:
Laura: Laurie
Lawrence: Larry
Leonard: Len Lenny
Leopold: Leo Poldi
Linda: Lindy
Lorenzo: Renzo
Lucy: Lu
Ludmila: Lyuda Mila
Małgorzata: Gosia
Marcus: Marc
Margaret: Maggie Meg Peggy Greta
Maria: Mia Mitzi
Mark:
Martin: Marty
Mary: Molly Polly
Matthew: Matt Matty
Megan: Meg
Mei:
Melissa: Mel Missy
Michael: Mike Mick Mickey
Michelle: Shelly
Mihály: Misi
Mohammed: Mo Hamid
Natalia: Natasha Talia
Nathaniel: Nate Nat
Nicholas: Nick Nicky
Nicole: Nikki
Olga: Olya
Olivia: Liv Livvy
Oluwaseun: Seun
Oscar:
Pamela: Pam
Patricia: Pat Patty Trish Tricia
Patrick: Paddy
Paul: Paulie
Pedro: Perico
Penelope: Penny
Peter: Pete
Philip: Phil
Pierre: Pierrot
Priyanka: Priya
Rachel: Rae
Ragnhild:
Rajesh: Raj
Raymond: Ray
Rebecca: Becky Becca
Richard: Rick Dick Richie Ricky
Robert: Rob Bob Bobby Robbie
Roberto:
Ronald: Ron Ronnie
Rosalind: Roz Rosie
Ruth: Ruthie
Samantha: Sam
Samuel: Sam Sammy
Sarah: Sally Sadie
Sergei: Seryozha
Sofia: Sophie
Søren:
Stanislav: Stas
Stephanie: Steph
Stephen: Steve Stevie
Susan: Sue Suzie Susie
Takahiro: Taka Hiro
Tatiana: Tanya Tania
Theodore: Theo Teddy
Theresa: Terry Tess
Thomas: Tom Tommy
Timothy: Tim Timmy
Valentina: Valya
Venkatesh: Venky Venkat
Victor: Vic
Victoria: Vicky Tori Vic
Vincent: Vince Vinnie
Vladimir: Volodya Vova
Walter: Walt Wally
Wei:
William: Will Bill Billy Liam
Wolfgang: Wolf
Xiaoming: Ming
Yevgeny: Zhenya
Yukiko: Yuki
Yusuf:
Zachary: Zach Zack
Zbigniew: Zbyszek
Zoltán: Zoli
"""

_PLAIN = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"})


def plain(word: str) -> str:
    """Lower case without accents."""
    folded = unicodedata.normalize("NFKD", word.casefold())
    return "".join(c for c in folded if not unicodedata.combining(c)).translate(_PLAIN)


def short_forms(text: str = GIVEN_NAMES) -> dict[str, list[str]]:
    """Plain full name -> plain short forms."""
    pairs = (line.split(":") for line in text.strip().splitlines())
    return {plain(full.strip()): [plain(s) for s in rest.split()] for full, rest in pairs}


def _umlauts(word: str) -> str:
    for a, b in (("ö", "oe"), ("ü", "ue"), ("ä", "ae"), ("ø", "oe"), ("å", "aa")):
        word = word.replace(a, b)
    return word


def full_names(text: str = GIVEN_NAMES) -> dict[str, set[str]]:
    """Plain full or short name (also with umlauts written out) -> the full names it may stand for."""
    out: dict[str, set[str]] = {}
    for line in text.strip().splitlines():
        full, rest = line.split(":")
        for name in (full, *rest.split()):
            for form in (plain(name), plain(_umlauts(unicodedata.normalize("NFC", name.strip().casefold())))):
                out.setdefault(form.strip(), set()).add(plain(full.strip()))
    return out
