"""Sentences written by hand, none made by the templates that the trees learn from. [[kind:span]] marks personal data; the rest holds none."""

CASES = """
Please send the signed form to [[email:jane.doe@example.org]] before Friday.
You can reach our archivist under [[email:maria [at] library [dot] org]] at any time.
His private address is [[email:tom.k (at) posthouse (dot) net]], not the one printed above.
If the link fails, write to [[email:helpdesk at northfield dot com]] and describe what you saw.
Kontakt: [[email:joe@example[dot]com]] heute noch.
Her assistant answers at [[email:k_larsen{at}fjord.no]] within a day.
Any questions? [[email:ask.us@mail.example.co.uk]] is read daily.
For refunds mail [[email:refunds [at] shop.example]] with the receipt.
The editor, [[email:o.brien@press.example]], replied at once.
contact [[email:anna.li at uni dot edu]] for the slides
My number changed, it is [[phone:(415) 555-0133]] now.
Ring the porter on [[phone:020 7946 0958]] if the gate is shut.
Call [[phone:555-014-7788]] and ask for Vera.
From abroad dial [[phone:+44 20 7946 0991]] and wait for the tone.
Dr. Osei can be phoned at [[phone:+1 (212) 555-0187]] until noon.
Fax the plan to [[phone:0049 30 901820 44]] please.
mobile: [[phone:07700 900 123]]
Leave a message on [[phone:303-555-0142]] after the beep.
WhatsApp us: [[phone:+34 612 345 678]].
The clinic's line is [[phone:(0161) 496 0312]].
She paid with the visa [[card:4111 1111 1111 1111]] in March.
Card on file: [[card:5500-0000-0000-0004]].
Please charge [[card:378282246310005]] for both rooms.
The stolen credit card, number [[card:6011 0009 9013 9424]], was blocked.
my mastercard is [[card:5105105105105100]] exp 04/27
debit card no. [[card:4000 0566 5566 5556]] declined twice
The form still shows [[card:4242424242424242]] in the log.
Payment by amex [[card:3714 496353 98431]] failed.
Logged in from [[ip:203.0.113.77]] at midnight.
The host [[ip:198.51.100.23]] stopped answering.
Blocked [[ip:192.0.2.146]] after ten tries.
Their server sits at [[ip:203[.]0[.]113[.]9]] as the report says.
client [[ip:10.20.30.40]] timed out
A second login came from [[ip:198 . 51 . 100 . 7]] an hour later.
The trace ends at [[ip:172.16.254.1]], inside the office.
Requests by [[ip:192[.]0[.]2[.]33]] look forged.
The meeting is at the hall at ten, not at the school.
We met at Lake House. But it rained.
Version 10.4.2 replaces 10.4.1 on all machines.
Order 4820113377 left the depot on 2023-11-04 at 08:15.
ISBN 978-3-16-148410-0 is out of print.
The total of 1 204 300 000 crowns was never repaid.
In 1998 and 1999 some 12 400 visitors came, in 2001 only 8 900.
Invoice #20231104-0007 lists 144 parts.
Serial 77881234567890123 was stamped on the frame.
The score was 3-1, then 4-2, and 112-98 in the end.
Chapter 3.2.1.4 explains the rule in full.
commit 9f8e7d6c5b4a39281706f5e4d3c2b1a0 fixed it
The ratio 0.125.0.3 is a misprint.
He ran 100 m in 11.4 s and 200 m in 23.0 s.
Look at page 404 and figure 12-7.
Room 212, floor 3, building 14.
Pi is 3.14159265358979 and e is 2.71828182845904.
The population grew from 1 200 000 to 1 350 000 in ten years.
At 10:30:15 the counter stood at 000123000000.
Ticket 555-01 was lost, ticket 555-02 found.
She arrived at noon. Dot by dot the picture grew.
Part no. 1234-5678-90 is no longer made.
Coordinates 52.5200, 13.4050 point to the square.
The years 1914-1918 and 1939-1945 are left out.
"""

#: Written after the trees were last changed, and never used to change them.
UNSEEN = """
Newsletter issues come from [[email:press@valley.example]] every Monday.
Write to [[email:sam at riverbank dot org]] about the boat.
Her old address was [[email:lucy.m [at] postbox [dot] net]] until June.
Complaints go to [[email:board(at)coop(dot)org]] only.
My mail is [[email:peter.hart at mailhost dot com]], please use it.
The warden answers on [[phone:(020) 7946 0123]] all night.
Phone me at [[phone:212-555-0175]] tomorrow.
Tel. [[phone:+49 30 5550 1234]] or by letter.
You may call [[phone:(503) 555-0129]] before lunch.
His cell is [[phone:0161 496 0876]], hers is not listed.
The card [[card:4012 8888 8888 1881]] was refused.
She read out [[card:5454-5454-5454-5454]] over the line.
credit card: [[card:6011111111111117]]
Refund it to [[card:3530 1113 3330 0000]] please.
We kept [[card:4222 2222 2222 2220]] by mistake.
Packets from [[ip:198.51.100.99]] were dropped.
She connected through [[ip:203[.]0[.]113[.]50]] twice.
The printer has [[ip:10.0.12.7]] as its name.
server [[ip:192 . 0 . 2 . 61]] is down
An alert named [[ip:172.31.4.250]] on Sunday.
He waited at the corner. Nobody came.
They dined at Oak Manor. The soup was cold.
Batch 20 4711 0815 33 was recalled.
On 12.03.2004 the bridge was closed for 14 days.
The prize of 5 000 000 was split by 1200 heirs.
Article 1234 5678 is sold out.
Between 1720 and 1850 the town grew from 800 to 4300 souls.
Phase 2-11-7 of the plan starts at 09:45.
The code AB-4471-9920-17 opens nothing.
Lines 100-140 and 2000-2045 were cut.
"""
