"""Texts for the residue operator, one a line: common residue of web pages and mails, and texts that only look like it.

These were read while the rules were made. ``residue_heldout.py`` and
``residue_fresh.py`` say how far theirs were.
"""

RESIDUE = """\
We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.
You need to enable JavaScript to run this app.
You need JavaScript to run this app.
JavaScript seems to be disabled in your browser.
JavaScript is required to view this page.
Please turn on JavaScript in your browser settings and refresh the page.
For full functionality of this site it is necessary to enable JavaScript.
This site requires JavaScript to work correctly.
Your browser does not support JavaScript!
It looks like your browser has JavaScript disabled. Please enable JavaScript to use this website.
Javascript must be enabled in order for you to use the Site in standard view.
We use JavaScript to show this content. Please switch it on and try again.
Please enable cookies and reload the page.
Cookies must be enabled to log in.
Your browser is out of date. Please update your browser to view this website correctly.
This browser is no longer supported. Please switch to a supported browser to continue.
Enable JavaScript and cookies to continue
Checking your browser before accessing the website.
This page needs JavaScript activated to work.
Sorry, you need to enable JavaScript to visit this website.
JavaScript has been disabled in your browser.
Please allow scripts on this page to see the comments.
This feature requires cookies. Please enable cookies in your browser.
Our website won't work without JavaScript.
JavaScript ist in Ihrem Browser deaktiviert.
Bitte aktivieren Sie JavaScript, um diese Website nutzen zu können.
Für die Nutzung dieser Seite muss JavaScript aktiviert sein.
Bitte erlauben Sie Cookies, um sich anzumelden.
Tato stránka vyžaduje JavaScript.
Pro správné zobrazení této stránky prosím povolte JavaScript.
Váš prohlížeč nepodporuje JavaScript.
Ta strona wymaga włączonej obsługi JavaScript.
Włącz JavaScript, aby korzystać z tej strony.
Veuillez activer JavaScript dans votre navigateur.
Ce site nécessite JavaScript pour fonctionner.
Por favor, active JavaScript en su navegador.
Necesita habilitar JavaScript para usar esta aplicación.
Per favore abilita JavaScript per continuare.
Ative o JavaScript no seu navegador para continuar.
このサイトを利用するにはJavaScriptを有効にしてください。
请启用 JavaScript 后重试。
To view this video please enable JavaScript, and consider upgrading to a web browser that supports HTML5 video.
This interactive map cannot be displayed because JavaScript is turned off.
Please disable your ad blocker and enable scripts to continue.
The comment form needs JavaScript. Please activate it in your browser.
404 Not Found
404 - Page not found
Page not found
Error 404: The page you are looking for does not exist.
Oops! That page can't be found.
It looks like nothing was found at this location.
Sorry, the page you were looking for could not be found.
The page you requested could not be found.
We couldn't find the page you were looking for.
The requested URL was not found on this server.
Sorry, this page isn't available.
This content is no longer available.
The link you followed may be broken, or the page may have been removed.
500 Internal Server Error
The server encountered an internal error and was unable to complete your request.
Something went wrong. Please try again later.
Oops, something went wrong.
An unexpected error occurred.
An error occurred while processing your request.
A fatal error has occurred. Please contact the administrator.
502 Bad Gateway
503 Service Temporarily Unavailable
The service is temporarily unavailable. Please try again in a few minutes.
504 Gateway Time-out
403 Forbidden
Access Denied
You don't have permission to access this resource.
Access to this page has been denied.
You are not authorized to view this page.
Error establishing a database connection
Could not connect to the database.
The connection has timed out.
This site can't be reached
Unable to connect to the server.
Your session has expired. Please log in again.
You have been logged out due to inactivity.
Please log in to continue.
Too many requests. Please try again later.
Sorry, you have been blocked
This account has been suspended.
The website is currently down for maintenance.
We are currently performing scheduled maintenance. We will be back soon.
Site under maintenance
This video is unavailable.
This file cannot be opened.
Failed to load resource
Failed to fetch
The document you requested has been moved or deleted.
Application error: a client-side exception has occurred
The request could not be satisfied.
No results found.
Your connection is not private
Seite nicht gefunden
Die angeforderte Seite konnte nicht gefunden werden.
Der Server ist vorübergehend nicht erreichbar.
Zugriff verweigert
Es ist ein Fehler aufgetreten. Bitte versuchen Sie es später erneut.
Stránka nebyla nalezena
Požadovaná stránka neexistuje.
Omlouváme se, došlo k chybě. Zkuste to prosím později.
Nie znaleziono strony
Przepraszamy, ta strona nie istnieje.
Brak dostępu
Página no encontrada
Lo sentimos, la página que busca no existe.
Page introuvable
Désolé, cette page n'existe pas.
Pagina non trovata
Página não encontrada
お探しのページは見つかりませんでした。
抱歉，您访问的页面不存在。
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Our mission: lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae.
Your text here
Your content goes here.
Add your description here.
Insert your text here
Type your paragraph here.
Click here to edit this text.
This is a sample text. Replace it with your own.
This is placeholder text.
Placeholder for the product description
Sample page content
Enter a short description here
Write something about yourself here.
Put your headline here
This is dummy copy. It is not meant to be read.
Title goes here
Image caption goes here
Body text goes here and continues here.
Replace this text with your own content.
Add a short bio here.
Coming soon
Platzhaltertext
Hier steht Ihr Text.
Hier kommt der Text hin.
Sem vložte text.
Zde napište popis.
Wpisz tutaj swój tekst
Votre texte ici
Su texto aquí
Inserisci qui il testo
ここにテキストを入力してください
asdf asdf asdf
test test test test
blah blah blah
xxxx xxxx xxxx xxxx
Dear [Customer Name], thank you for your order.
Hello {{first_name}}, welcome back!
Hi {name}, your parcel is on its way.
Dear ${recipient}, please find the invoice attached.
Best regards, [Your Name]
[Company Name] is committed to your privacy.
Contact us at [email address] or [phone number].
This agreement is made on [date] between [Party Name] and [Client Name].
Sincerely, [Your Full Name] [Your Title]
Please send your reply to <insert email here>.
Welcome to %SITE_NAME%!
Hello %s, you have new messages.
Invoice number: {{ invoice.number }}
Total due: [AMOUNT]
The meeting will take place on [DATE] at [TIME].
Prepared by: ______________
Name: ________ Date: ________
[Insert company logo here]
[Your text here]
{% block content %} {% endblock %}
Hi *|FNAME|*, thanks for signing up.
Dear Mr./Mrs. [Last Name],
I am writing to apply for the [Job Title] position at [Company].
Thank you for your interest in {company_name}.
Order #{{order_id}} has shipped.
Address: [Street Address], [City], [State], [ZIP Code]
The price is $[PRICE] per month.
Subject: [SUBJECT LINE]
On behalf of [Organization Name], we invite you.
Hello undefined, your order is ready.
Welcome, null_value!
You owe NaN dollars to [object Object].
Dear {Title} {Surname},
Dear <First Name>,
Hello @@username@@,
Sehr geehrte/r [Name einfügen], vielen Dank.
Vážený [doplňte jméno], děkujeme.
Szanowny Panie [nazwisko], dziękujemy.
Cher [Nom], merci de votre commande.
Estimado [Nombre]: gracias por su compra.
Date: DD/MM/YYYY
From: [Your Company] To: [Recipient]
Copyright [year] [fullname]
Welcome to <company_name>, your account is ready.
Our office is located at {{ address }} in {{ city }}.
The <<event_name>> takes place in <<venue>>.
TODO: write the introduction
[TBD]
""".splitlines()

LOOKALIKES = """\
We decided to enable JavaScript minification in the build last week.
JavaScript was created by Brendan Eich in ten days in May 1995.
The tutorial explains how to enable JavaScript in older versions of the browser.
Many users disable JavaScript because of advertising trackers.
Peter said that the intranet does not work without JavaScript.
The team removed all scripts from the checkout flow to speed it up.
Cookies are baked at 180 degrees for twelve minutes.
She wrote the scripts for the first two seasons of the series.
Browsers parse HTML into a tree before they run any scripts.
The new law requires consent before cookies are stored.
In the lecture she compared JavaScript engines from three vendors.
The bakery sells cookies without sugar.
Our crawler renders pages with JavaScript because half of the shops need it.
The message "Please enable JavaScript" confused visitors for months.
Set `javascript.enabled` to true in the profile.
The actor needs the script by Monday.
He turned on the radio and read the script once more.
Screen readers handle scripts well if the page announces changes.
The survey shows that one percent of visitors block scripts.
A cookie is a small piece of data stored by the browser.
Old browsers supported only a subset of the style rules.
Support for the old browser ended after the vendor stopped shipping updates.
The festival requires scripts of at most forty pages.
Our guide lists browsers that the museum tablets can run.
The developer blog describes why cookies had to be partitioned.
Die Schauspielerin lernte das Skript in drei Tagen.
Im Kurs lernen die Schüler JavaScript und Python.
Scénář potřebuje ještě dvě úpravy, řekl režisér.
Skrypty z zajęć wykładowca udostępnia studentom po każdym semestrze.
Les étudiants apprennent JavaScript en deux semaines.
El curso de JavaScript empieza en septiembre.
JavaScriptは1995年に登場したプログラミング言語である。
The board approved the budget for the new website in March.
A browser extension helped the librarians to archive old pages.
Allowing cookies on the school tablets was a decision of the parents' council.
The hikers could not find the trail after the storm.
The missing page of the manuscript was found in Vienna.
The page was torn out of the book long before the archive bought it.
Scientists found an error in the original calculation.
The error of the instrument is below two percent.
The minister was denied access to the building, according to witnesses.
Access to clean water remains a problem in the region.
The forbidden city attracts millions of visitors each year.
His passport had expired two days before the flight.
The milk expired on Friday, so we threw it away.
The gateway to the castle was rebuilt in 1890.
The server brought two coffees and a slice of cake.
The service was slow but the food was excellent.
The connection between diet and sleep is not fully understood.
The police could not establish a connection between the two cases.
A database of bird calls helps researchers in the field.
The report was not found in the archive, so the historian asked the family.
The file of the accused contained forty letters.
The museum is closed for maintenance of the heating until April, the mayor said.
Maintenance of the bridge costs two million a year.
Engineers discussed why the server returned status 500 under load.
In HTTP, status 404 means that a resource was not found.
The 503 bus no longer stops at the market square.
Highway 404 connects Toronto with Newmarket.
Our incident review lists three outages of the payment service in May.
The log contained the line "connection timed out" forty times.
The function returns `null` if the file does not exist.
If the request fails, the client retries three times with backoff.
The test checks that a missing record gives an empty list.
Users complained that the session expired too quickly, so we doubled the timeout.
The suspect refused to answer and the session was adjourned.
Too many cooks spoil the broth.
Too many requests for school places reached the council this year.
The account of the voyage was published in 1771.
The temple was removed stone by stone and rebuilt on higher ground.
The company moved its headquarters to Lyon in 2015.
The post was deleted by its author after a heated debate.
The video of the landing was watched by millions.
The results of the election are not available before Monday, officials say.
No survivors were found after the avalanche.
The lost ring was found at the bottom of the lake.
She failed to open the jar and asked her brother.
The engine failed to start in the cold.
The appeal was rejected by the court in Brno.
Something went wrong in the oven and the bread came out flat.
An unexpected guest arrived at midnight.
The internal market of the union was completed in 1993.
The archive does not exist any more; it burned down in 1944.
The author argues that absolute freedom does not exist.
Die Polizei konnte den Täter nicht finden.
Der Zugang zum Turm ist wegen Bauarbeiten bis Herbst gesperrt, teilte die Stadt mit.
Das Buch wurde nach hundert Jahren in einem Kloster gefunden.
Archeologové nalezli hrob z doby bronzové.
Chyba v překladu způsobila diplomatický spor.
Ta strona rzeki jest spokojniejsza niż druga.
Strona powodowa nie stawiła się na rozprawie.
La page manquante du manuscrit a été retrouvée à Lyon.
El servicio de trenes se reanudó por la tarde.
ページをめくる音が静かな図書館に響いた。
The wiki page about rivers needs more photographs of the delta.
The error page of the shop shows a picture of a lost dog.
Visitors like the museum's error page so much that it became a poster.
We measured how often the gateway refused connections during the test.
The administrator of the estate sold the paintings.
The chapter on lost letters is my favourite part of the book.
Return to the start of the trail and take the left path.
Go back to the village and follow the river for two miles.
The contact person for the excursion is the teacher of biology.
Please contact the museum if you find a coin of this type.
Please try the soup again once it has cooled.
Wait ten minutes and then check the temperature of the dough.
The address of the new clinic is 14 Mill Lane.
The status of the species was changed to endangered in 2019.
The code of Hammurabi contains 282 rules.
Lorem ipsum is a mangled passage of Cicero that printers have used since the 1500s.
The phrase "lorem ipsum" comes from a text of Cicero.
Typesetters used dummy text long before computers, as the exhibition shows.
Cicero wrote: neque porro quisquam est qui dolorem ipsum quia dolor sit amet.
The choir sang Dona nobis pacem and Agnus Dei.
Sic transit gloria mundi, said the old teacher.
The species Quercus robur grows in most of Europe.
The sample was placed in the freezer at minus eighty degrees.
The sample text in the study had two thousand words.
Crash tests use dummies with sensors in the neck.
The placeholder in the form was replaced with a real label.
Filler words such as well and like are common in speech.
Wall filler dries in about an hour.
The title goes to the team with the most points.
The description of the beetle was published by Linnaeus.
The body was found here in 1991 by two hikers.
Here the text breaks off, and the rest of the scroll is lost.
The text of the treaty is kept here in the national archive.
Insert the key here and turn it to the left, the manual said.
The new season is coming soon to theatres in Prague, according to the director.
Spring is coming soon and the gardens need work.
Text written on papyrus fades in sunlight.
The caption of the photograph names all seven players.
The copy of the letter was sent to the king.
Write to the editor if you know the author of this poem.
Der Titel ging an die Mannschaft aus Bremen.
Hier steht das älteste Haus der Stadt.
Zde stál hrad, který byl zbořen v roce 1620.
Tutaj rzeka skręca na południe.
Ici commence la route du sel.
Aquí nació el poeta en 1898.
Blah, he said, and shrugged.
The band Xxx played its first show in Leeds.
Type theory is a branch of logic.
Dummy variables encode categories in a regression.
The boilerplate clause was struck down by the court.
The word placeholder appears forty times in the style guide.
See [1] and [2] for the proof.
As noted in [Smith 2020], the effect is small.
The witness said he [the driver] was asleep.
Use [the guide](https://example.org/guide) to get started.
The interval [0, 1] is compact.
- [x] buy milk
- [ ] call the plumber
The list comprehension `[name for name in names]` is faster.
The template uses `{{ name }}` for the recipient.
In Jinja, "{{ name }}" prints a variable.
The set {1, 2, 3} has eight subsets.
f(x) = x^2 for all x in {a, b, c}
The price rose from $5 to $7 in a year.
It costs $20 plus tax, or $25 with shipping.
Inflation was 5% in May and 7% in June.
The tag #throwback was popular in 2014.
Chapter #3 was rewritten twice.
a < b and b > c imply nothing about a and c.
Send mail to jane.doe@example.org for details.
The result is 3 << 2, which is 12.
He answered "[your name] is on the list", which was a joke.
The form asked for `[first name]` in square brackets.
The song is called Undefined Love.
The value of a division by zero is not defined.
Her name was on the list of winners.
Dates are written day first in most of Europe.
The office is in the city centre, close to the station.
The date format differs between countries.
We met at 10:30... and then waited for an hour.
And so... the story ends.
The underscore in file_name is allowed.
The constant MAX_VALUE is set in the header file.
The variable __init__ is called first.
<b>Bold</b> text was common on early pages.
<p>The harbour was busy in the morning.</p>
The quote [...] was shortened by the editor.
The words “Access denied” were painted on the door.
```
404 not found
please enable javascript
```
Run `curl -I` and you will see `404 Not Found`.
> The river rose by two metres overnight.
| name | date | amount |
The company name was changed in 1998.
Dear Mrs. Novak, thank you for your letter of 3 May.
Best regards, Anna Schmidt
Thank you for your order of two books; they were sent on Tuesday.
Your parcel was handed to your neighbour, Mr. Klein.
The invoice for March amounts to 240 euros.
The meeting takes place on 4 June at 10 o'clock in room 12.
Name: Jan Dvorak, Date: 3 May 2021
The undersigned, Maria Rossi, lives at 4 Via Roma.
The list of names was read aloud at the ceremony.
He signed as John Doe to stay anonymous.
Customers receive a message once their order has shipped.
The teacher wrote the names of all students on the board.
Every company must publish its address and phone number.
The year and title of the painting are unknown.
""".splitlines()
