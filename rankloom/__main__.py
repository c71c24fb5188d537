from rankloom.cli import main

main()
