"""Texts for the residue operator written after its last change and scored once; one a line."""

RESIDUE = """\
Scripts appear to be off. Turn them on to view the gallery.
This dashboard is powered by JavaScript, which your browser has turned off.
Please use a browser with JavaScript.
The map requires JavaScript. Please enable it.
We need cookies to keep you signed in. Please allow them.
You must enable JavaScript to submit this form.
Your privacy settings are blocking this embedded content.
Ohne JavaScript kann diese Seite nicht angezeigt werden.
Pro zobrazení mapy je nutné povolit JavaScript.
Aby obejrzeć film, włącz JavaScript.
JavaScript doit être activé pour utiliser ce service.
Este sitio requiere JavaScript.
Abilita i cookie per continuare.
The requested document does not exist.
That page seems to have gone missing.
We searched everywhere but could not find this page.
Error code 404
Sorry, we couldn't load this post.
Couldn't load comments. Try again.
Nothing found. Try a different search.
This profile is private.
This video has been removed by the uploader.
Article not available in your region.
The server returned error 500.
Whoops! There was an error.
Our servers are busy. Please try again in a minute.
Service unavailable. Back soon.
We are updating our site. Please come back later.
Proxy error: could not connect to origin server.
SSL connection failed.
DNS lookup failed.
Token expired. Sign in again.
You don't have access to this folder.
Sign in to continue.
Your account is locked. Contact support.
Please complete the captcha to continue.
Die Datei wurde nicht gefunden.
Der Zugriff auf diese Seite ist gesperrt.
Chyba serveru
Obsah není dostupný.
Wystąpił błąd. Spróbuj ponownie.
Le service est temporairement indisponible.
El archivo no existe.
Il server non risponde.
このコンテンツは表示できません。
Aliquam erat volutpat, sed diam nonummy nibh euismod tincidunt ut laoreet dolore.
Suspendisse potenti. Nulla facilisi lorem ipsum dolor sit amet.
Quote goes here
Your logo here
Button text
Type your answer here
Add text
Edit this paragraph to tell visitors about your business.
I'm a paragraph. Click here to add your own text.
Description coming soon.
Placeholder image
Sample headline
Zde doplňte text
Hier Text eingeben
Wstaw tekst tutaj
la la la la la
Dear [Mr./Ms. Last Name],
Hi {{ user.firstname | default }},
Thanks, {{agent_name}}
Ship to: ${address.line1}
[PRODUCT NAME] is the best choice.
This contract is dated [DD Month YYYY].
The parties, [Party A] and [Party B], agree.
Your code: {OTP}
Kind regards, <Name>
Liebe(r) [Kundenname],
Vážená paní [příjmení],
Signed: ______________________
[insert quote]
""".splitlines()

LOOKALIKES = """\
She taught JavaScript at the college for twenty years.
The scripts of the opera were lost in a fire.
Cookies were served after the concert.
Our reviewer tried five browsers on an old laptop.
The plug-in market grew by a tenth.
Without scripts, the archive of the radio plays is hard to read.
Der Autor schrieb JavaScript zuerst mit kleinem s.
V prohlížeči fotografií lze otáčet snímky.
The search for the missing page lasted a decade.
The document does not mention the king by name.
The file lay unread in the ministry for years.
The error was discovered by a student.
Two errors in the score were corrected in ink.
The service begins at nine and ends at ten.
The server at the inn remembered the poet.
The club was closed after midnight.
The connection to the mainland runs twice a day.
No one was found in the house.
The path was blocked by snow until April.
The visa expires in June.
The king denied them access to the sea.
The session of parliament was opened by the queen.
The requests of the farmers were ignored.
The gateway of the abbey dates from 1300.
Visitors need permission from the abbot to enter the cloister.
The moon was not visible that night.
The bridge is currently the longest in Asia.
The account of the siege is not reliable.
The page boy carried the letter.
The network of canals was dug by hand.
An unexpected storm delayed the fleet.
The results were unknown until the next morning.
Die Seite des Berges ist steil.
Der Fehler kostete den Verlag viel Geld.
Chyby v mapě opravil až další vydavatel.
Strona tytułowa zawiera herb miasta.
La page d'accueil du guide décrit la vallée.
El error fue descubierto en 1987.
Il sito archeologico è aperto in estate.
ページ数は三百を超える。
The Latin word dolor means pain.
In vino veritas, as the Romans said.
The logo shows a heron and a river.
The quote comes from a letter to his sister.
Button makers worked in the town until 1920.
The answer was typed on a yellow card.
The sample of soil was dry.
The paragraph was cut by the censor.
A new edition is coming in autumn.
The image shows a farm in winter.
Klara legte den Text auf den Tisch.
Obraz visí tady už sto let.
The list has three entries: a, b and c.
The bill came to $40 and $5 for coats.
Rates fell by 2% and rose by 4% later.
See footnote [12] for the source.
He wrote "[name withheld]" on the form.
Use `{{ title }}` in the header.
The set {2, 3, 5} holds primes.
The label <i>North</i> is set in italics.
[Read more](https://example.org/more)
The party signed the contract on 4 May 2010.
Dear Aunt Rosa, the weather is fine.
Kind regards, Paul
The name on the parcel was smudged.
The address of the king was short.
She waited for ten days... then left.
A product of the region is plum brandy.
The city and the date are carved in stone.
The first name was painted over.
Her message was brief and kind.
The title page is missing from our copy.
The box was empty and the lid was broken.
It was the wrong house.
""".splitlines()
